"""The methods against plain versions: formats round trip, merges sort, models sum to one, links and passages are complete."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prosewell.llm import avi, compact_windows, components, minhash, mixing, quality, suffix_sort, suffix_tree_lm, tokens
from prosewell.llm.scratch import Scratch
from prosewell.llm.suffix_tree_lm import Tree, context_hash
from prosewell.llm.wavelet import WaveletFile, encode

rng = random.Random(5)


@pytest.mark.parametrize("planes,n", [(1, 0), (3, 1), (16, 70_000), (20, 5000)])
def test_wavelet_round_trip(planes, n):
    ids = np.array([min((1 << planes) - 1, int(rng.expovariate(1 / 300))) for _ in range(n)], np.uint32)
    cuts = np.array(sorted(rng.sample(range(n + 1), min(n, 5))) + [n])
    file = WaveletFile(encode(ids, np.arange(len(cuts)), cuts, planes))
    assert (file.tokens() == ids).all() and (file.ends == cuts).all()
    for i in rng.sample(range(n), min(n, 40)):
        t = int(ids[i])
        where = np.flatnonzero(ids == t)
        assert file.access(i) == t and file.count(t) == len(where) and file.count(t, 0, i) == (where < i).sum()
        assert file.find(t, len(where) - 1) == where[-1] and file.find(t, 0) == where[0]


def test_avi_round_trip():
    for n in (64, 1024, 1088, 64 * 50):
        payload = np.array([rng.randrange(256) for _ in range(n)], np.uint8)
        data = avi.encode_avi(payload)
        file = avi.parse_avi(data)
        decoded = avi.decode_frames(file["frames"])
        assert b"".join(avi.stored_bytes(c).tobytes() for c, *_ in decoded)[:n] == payload.tobytes()
        assert len(file["frames"]) == -(-n // 1024) and data[:4] == b"RIFF"
        assert avi.histograms(decoded).sum() == len(file["frames"]) * 1024
        # the general reader reads the writer's tables too
        height, width, interval, ((quant, _, _, dc, ac),) = avi._parse_header(file["frames"][0][: file["frames"][0].index(b"\xff\xda") + 10])
        assert (height, width, interval) == (32, 32, 1) and avi._huffman_blocks(bytes([0, 200] * 64), [(1, dc, ac)], 1)[0][0, 5] == 200


def color_jpeg(luma: list[int], height=16, width=16) -> bytes:
    """A frame of three components, luma twice as fine, flat blocks only, without tables of its own for codes."""
    import struct

    codes = {k: {v: c for c, v in t.items()} for k, t in avi.STANDARD.items()}
    out, last = [], [0, 0, 0]

    def flat(c: int, value: int) -> None:
        diff, last[c] = value - last[c], value
        size = abs(diff).bit_length()
        for bits, code in (codes[0, min(c, 1)][size], (size, diff if diff > 0 else diff + (1 << size) - 1), codes[1, min(c, 1)][0]):
            out.append(format(code, f"0{bits}b") if bits else "")

    for unit in range(len(luma) // 4):
        for v in luma[4 * unit : 4 * unit + 4]:
            flat(0, v)
        flat(1, 3), flat(2, -3)
    bits = "".join(out)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([8] * 64)) + segment(0xC0, frame) + segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + b"\xff\xd9"


def test_color_frames_by_the_standard_tables():
    luma = [rng.randrange(-100, 100) for _ in range(16)]
    ((coefficients, quant, height, width),) = avi.decode_frames([color_jpeg(luma, 32, 32)])
    assert coefficients[:, 0].tolist() == luma and not coefficients[:, 1:].any() and (height, width, int(quant[0])) == (32, 32, 8)
    assert [len(avi.STANDARD[k]) for k in ((0, 0), (0, 1), (1, 0), (1, 1))] == [12, 12, 162, 162]
    for broken in (color_jpeg(luma, 64, 64), color_jpeg(luma)[:40], b"", b"\xff\xd8\xff\xda"):
        with pytest.raises((ValueError, LookupError, __import__("struct").error)):
            avi.decode_frames([broken])


def test_damaged_files_are_told(spark):
    from prosewell.llm import media

    good = avi.encode_avi(np.arange(1024, dtype=np.uint8))
    rows = [(1, good), (2, good[: len(good) // 2]), (3, b"RIFF"), (4, None), (5, b"")]
    got = {}
    for r in media.clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got.setdefault(r["doc_id"], []).append(r["clip"])
    assert got[1] == [0] and got[3] == [None] and 4 not in got and got[5] == [None] and 2 in got


def test_quality_is_a_plain_discriminant():
    """Sums, cached factors and all against the textbook formula over the rows themselves."""
    x = np.random.default_rng(4).normal(size=(400, 5)) * [1, 2, 3, 0.5, 1]
    y = (x[:, 0] + 0.3 * x[:, 1] ** 2 > 1).astype(int)
    model = quality.fit_sums({k: (float((y == k).sum()), x[y == k].sum(0), x[y == k].T @ x[y == k]) for k in (0, 1)})
    z, logs = (x - x.mean(0)) / x.std(0), []
    for k in (0, 1):
        own = z[y == k]
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.eye(5) * np.trace(cov) / 5 + 1e-6 * np.eye(5)
        off = z - own.mean(0)
        logs.append(np.log((len(own) + 1) / 402) - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_shots():
    calm, other = [100, 0, 0, 0], [0, 0, 100, 0]
    assert avi.shots(np.array([calm] * 5 + [other] * 5)) == [(0, 5), (5, 10)]
    assert avi.shots(np.array([calm] * 4)) == [(0, 4)]


def test_loser_tree_merges():
    width = 6
    for k in (1, 2, 3, 7):
        runs = [sorted({bytes(rng.choice(b"ab\0") for _ in range(width)) for _ in range(rng.randrange(0, 40))}) for _ in range(k)]
        coded = [suffix_sort.front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, width)) for r in runs]
        got = list(suffix_sort.merge([suffix_sort.decode(s, t.tobytes(), width) for s, t in coded], width))
        assert [x for _, _, x in got] == sorted(x for r in runs for x in r)
        for (_, _, a), (share, _, b) in zip(got, got[1:], strict=False):
            assert share == next((i for i in range(width) if a[i] != b[i]), width)


def test_components(spark):
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(900, 1000)] + [(k, k + 1) for k in range(2000, 2060)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


def _variants(base: list[str], n: int, edits: int) -> list[list[str]]:
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(words)
    return out


def test_minhash_finds_every_link(spark):
    """A dense group whose members are not all linked with its smallest, against all pairs."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = [w for e in (1, 2, 3) for w in _variants(base, 25, e)] + [[f"y{rng.randrange(10**6)}" for _ in range(60)] for _ in range(30)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in range(len(sets))}


def test_compact_windows_are_all_minima():
    values = np.array([rng.randrange(1 << 60) for _ in range(300)], np.uint64)
    text, minimum, low, at, high = compact_windows.compact_windows(values, np.array([0, 300]), 0, least=20)
    h = tokens.mix(values * compact_windows._MULTIPLY[0] + compact_windows._ADD[0])
    want = {(int(h[i : j + 1].argmin()) + i) for i in range(300) for j in range(i + 19, 300)}
    assert set(at.tolist()) == want
    for c, left, right in zip(at, low, high, strict=True):
        assert h[left : right + 1].argmin() + left == c and (left == 0 or h[left - 1] < h[c]) and (right == 299 or h[right + 1] < h[c])


def test_compact_windows_find_planted_passages(spark):
    word = lambda: f"v{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    edited = list(passage)
    edited[30] = word()
    rows = [(k, [word() for _ in range(200)]) for k in range(12)]
    for k, p in ((2, passage), (5, passage), (9, edited)):
        rows[k][1][50:50] = p
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in compact_windows.linked(docs).collect()}
    assert {k for k, r in got.items() if r["component_id"] == 2} == {2, 5, 9}
    assert got[5]["dup_words"] >= 60 and all(r["n_links"] == 0 for k, r in got.items() if k not in (2, 5, 9))


def test_suffix_tree_sums_to_one():
    heads = np.sort(np.array([rng.getrandbits(63) for _ in range(20)], np.uint64))
    counts = np.array([rng.randrange(5, 50) for _ in range(20)])
    tree = Tree(int(counts.sum()) + 7, 25, heads, counts)
    context = np.sort(context_hash([heads[:3]]))
    key = np.array([(c << 32) | w for c in range(3) for w in range(0, 20, 4 + c)], np.uint64)
    tree.grow(context, np.array([100, 100, 100]), [], key, np.full(len(key), 15))
    assert len(tree.parent) > 1
    unseen = 25 - 20 + 1  # words that aren't frequent, and the unknown one, at their single-word probability
    rest = 1 - (10**tree.root).sum()
    for state in range(len(tree.parent)):
        known = (10 ** tree.log_p(np.full(20, state), np.arange(20))).sum()
        other = 10 ** tree.log_p(np.array([state]), np.array([-1]))[0] * rest
        assert abs(known + other - 1) < 1e-9 and unseen


def test_mixing_comes_near_its_targets(spark):
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), f"s{k % 5 if k % 3 else 0}") for k in range(4000)]
    got = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=64).toPandas().merge(__import__("pandas").DataFrame(rows, columns=["doc_id", "text", "source"]), on="doc_id")
    size = got.groupby("source")["size"].sum()
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size.index))}
    target, fixed = {}, {}
    while True:
        free = [s for s in size.index if s not in fixed]
        left = size.sum() - sum(fixed.values())
        target = fixed | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * size[s] for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    for s, part in got.groupby("source"):
        assert abs(part["target"].iloc[0] - target[s]) < 1e-6
        assert abs((part["size"] * part["copies"]).sum() - target[s]) <= 60


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = quality.query(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_suffix_tree_learns_by_fixed_counts(spark):
    """A pair that was learned stays learned, and more contexts come, however many other tokens are added."""
    other = lambda k: " ".join(f"w{k}x{i % 7}y{i}" for i in range(4000))
    few = [(k, f"alpha{k % 5} beta{k % 5}") for k in range(1, 21)]
    few = [(k, t) for k, t in few if zlib.crc32(str(k).encode()) % 10]
    gain = []
    for more in (0, 60):
        rows = few + [(1000 + k, other(k)) for k in range(more)]
        got = {r["doc_id"]: r for r in suffix_tree_lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        gain.append(got[few[0][0]]["score"] - got[few[0][0]]["base_score"])
    assert gain[1] > gain[0] > 0.5


def test_suffix_tree_in_shares_is_the_tree_in_one_place(spark):
    rng = random.Random(6)
    words = [f"w{int(60 * rng.random() ** 2)}" for _ in range(6000)]
    for i in range(2, len(words)):
        if rng.random() < 0.5:
            words[i] = f"w{(int(words[i - 1][1:]) * 7 + int(words[i - 2][1:])) % 60}"
    rows = [(k, " ".join(words[20 * k : 20 * k + 20])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in suffix_tree_lm.score_corpus(docs).collect()}

    texts = [[*(t.split()), None] for _, t in rows]
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 10]
    hashes = tokens.words(*tokens.text_bytes(pa.array([" ".join(sorted({w for t in texts for w in t if w}))]))).hashes
    number = dict(zip(sorted({w for t in texts for w in t if w}), hashes, strict=True)) | {None: suffix_tree_lm.END}
    seen = Counter(w for t in train for w in t)
    heads = np.array(sorted(number[w] for w in seen), np.uint64)
    symbol = {w: int(np.searchsorted(heads, number[w])) for w in seen}
    counts = np.zeros(len(heads), np.int64)
    for w, n in seen.items():
        counts[symbol[w]] = n
    tree = Tree(int(counts.sum()), len(heads), heads, counts)
    hashed = lambda c: int(context_hash([np.array([number[w]], np.uint64) for w in c])[0])
    for d in (1, 2, 3):
        grams = Counter((tuple(reversed(t[i - d : i])), t[i]) for t in train for i in range(d, len(t)))
        occurs = Counter()
        for (c, _), n in grams.items():
            occurs[c] += n
        contexts = sorted((c for c, n in occurs.items() if n >= 2), key=hashed)
        place = {c: i for i, c in enumerate(contexts)}
        entries = [((place[c] << 32) | symbol[w], n) for (c, w), n in grams.items() if c in place and n >= 2]
        suffixes = [np.array([hashed(c[:k]) for c in contexts], np.uint64) for k in range(1, d)]
        tree.grow(np.array([hashed(c) for c in contexts], np.uint64), np.array([occurs[c] for c in contexts]), suffixes, np.array([k for k, _ in entries], np.uint64), np.array([n for _, n in entries]))
    assert len({len(lookup.keys) for lookup, _ in tree.levels}) > 1 and len(tree.parent) > 50
    for k, t in enumerate(texts):
        want = base = 0.0
        for i, w in enumerate(t):
            past = [np.array([hashed(tuple(reversed(t[i - d : i])))], np.uint64) for d in range(1, min(i, 3) + 1)]
            log = float(tree.log_p(tree.state(past, 1), np.array([symbol.get(w, -1)]))[0])
            one = 0.0 if w in symbol else np.log10(suffix_tree_lm.SMOOTH) - tree.log_norm
            want += log + one
            base += float(tree.root[symbol[w]]) if w in symbol else one
        assert abs(got[k]["score"] - want) < 1e-4 and abs(got[k]["base_score"] - base) < 1e-6
        assert got[k]["train_tokens"] == counts.sum() and got[k]["n_known"] == sum(w in symbol for w in t)


@pytest.mark.parametrize("size", [50, 53, 60])
def test_compact_windows_verify_edits_at_every_word(size):
    rng = random.Random(7)
    word = lambda: rng.getrandbits(60)
    shingles = lambda w: np.array([hash(tuple(w[i : i + 5])) & ((1 << 62) - 1) for i in range(len(w) - 4)], np.uint64)
    for at in range(size):
        passage = [word() for _ in range(size)]
        edited = [*passage[:at], word(), *passage[at + 1 :]]
        a, b = ([shingles([*(word() for _ in range(n)), *p, *(word() for _ in range(80))]) for n, p in ((80, passage), (60, edited))])
        x, y = set(shingles(passage).tolist()), set(shingles(edited).tolist())
        if 100 * len(x & y) >= 80 * len(x | y):
            assert compact_windows.verified(a, b, (0, len(a), 0, len(b), -20))


def test_compact_windows_compare_what_the_smallest_does_not_share(spark):
    """Every shingle of the passage of 2 and 5 is in 0 or 1 and again in 3 or 4, each of which is too unlike the passage as a whole."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    one, two = ([word() if i in places else w for i, w in enumerate(passage)] for places in ((2, 9, 16, 23), (33, 40, 47, 54)))
    texts = [[*(word() for _ in range(100)), *t, *(word() for _ in range(100))] for t in (one, two, passage, one, two, passage)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in compact_windows.linked(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2}
