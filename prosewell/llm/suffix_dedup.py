"""Suffix-array deduplication of repeated byte strings by a distributed merge sort that knows common prefixes.

A byte goes if a string of LENGTH bytes over it also starts in a document of a smaller id.  Every such string holds an anchor: a
position whose GRAM-byte hash is the least of a window, so equal strings have equal anchors at equal places, and the suffixes at
anchors (about one position in seventeen) suffice.  The steps:

1. Each input partition stores its texts in the shared folder and sends the hashes of its anchors, cut by hash, in sorted lists.
2. Hashes of several documents go back to the partitions that have them.
3. These sort the suffixes at such anchors (LENGTH bytes on, then the bytes before, backwards) in runs, and send each run cut at common
   splitters, front-coded; of equal suffixes only one goes, with the least document id.
4. Each range of suffixes is merged by a loser tree.  Neighbours that share GRAM bytes are one group; for every string of LENGTH bytes
   around the anchor the group finds its least document.  That goes back to each run.
5. The partitions cover what has a smaller document, and cut the texts.

Documents and their positions never leave their partition; what travels are distinct strings and least ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prosewell.llm.scratch import Scratch
from prosewell.llm.sharing import NO_ID, Files, several, store_and_hash, tasks
from prosewell.llm.suffix_sort import decode, front_code, merge
from prosewell.llm.tokens import U64, mix, sliding_min, stream, text_bytes

LENGTH, GRAM = 50, 16
#: Anchor hashes that each of so many windows starts choose from.
CHOICE = LENGTH - GRAM + 1
BEFORE = CHOICE - 1
WIDTH = LENGTH + BEFORE + 2
#: Suffixes whose strings are compared at once; a group is never split.
CLOSE = 20_000
#: Bytes of text whose suffixes make one run.
RUN_BYTES = 8 << 20

_TABLE = stream(6, 256)
_STEP = 0xD1342543DE82EF95
_UP = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_UP[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 21), base, U64)
            steps[0] = 1
            _UP[k] = np.cumprod(steps)
    return _UP


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of joined texts."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = _powers(len(raw))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(_TABLE[raw] * up[: len(raw)])])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1])
    low = sliding_min(h, CHOICE)
    for end in offsets[1:].tolist():  # windows that run over the end of a text
        low[max(0, end - LENGTH + 1) : end] = 0
    pad = np.zeros(BEFORE, U64)
    most = ~sliding_min(~np.concatenate([pad, low, pad]), CHOICE)
    at = np.flatnonzero((h == most) & (most > 0))
    return at, h[at]


def suffixes(raw: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of WIDTH bytes: LENGTH bytes from each position on, the BEFORE bytes before it backwards, and 1 + how many of each its text has."""
    text = np.searchsorted(offsets, at, "right") - 1
    after, before = np.minimum(offsets[text + 1] - at, LENGTH), np.minimum(at - offsets[text], BEFORE)
    out = np.zeros((len(at), WIDTH), np.uint8)
    for j in range(LENGTH):
        some = after > j
        out[some, j] = raw[at[some] + j]
    for j in range(BEFORE):
        some = before > j
        out[some, LENGTH + j] = raw[at[some] - 1 - j]
    out[:, -2], out[:, -1] = after + 1, before + 1
    return out


def _hashes(raw: np.ndarray, offsets: np.ndarray):
    """Anchors for step 1, and a few of their suffixes for the splitters."""
    at, h = anchors(raw, offsets)
    return np.searchsorted(offsets, at, "right") - 1, h, [x.tobytes() for x in suffixes(raw, offsets, at[:: max(1, len(at) // 4)][:4])]


def _runs(batches):
    """The stored texts in parts of about RUN_BYTES."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= RUN_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _loaded(run: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(run)
    raw, offsets = text_bytes(table.column("text"))
    return table.column("doc_id").to_numpy(), raw, offsets


def _shared_anchors(run: list[pa.RecordBatch], hashes: np.ndarray) -> np.ndarray:
    """Positions, in the joined texts of a run, of the anchors with these hashes; the batches are hashed one at a time."""
    found, base = [np.zeros(0, np.int64)], 0
    for batch in run:
        raw, offsets = text_bytes(batch.column("text"))
        at, h = anchors(raw, offsets)
        if len(hashes):
            key = h >> U64(8)
            found.append(base + at[hashes[np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)] == key])
        base += len(raw)
    return np.concatenate(found)


def _sorted_runs(found: DataFrame, folder: str, splitters: np.ndarray) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(splitters)

    def runs(part: int, hashes: np.ndarray):
        files = Files(folder)
        for number, held in enumerate(_runs(files.batches(f"texts-{part}"))):
            ids, raw, offsets = _loaded(held)
            at = _shared_anchors(held, hashes)
            rows = np.ascontiguousarray(suffixes(raw, offsets, at)).view(f"S{WIDTH}").ravel()
            distinct, which = np.unique(rows, return_inverse=True)
            doc = ids[np.searchsorted(offsets, at, "right") - 1]
            least = np.full(len(distinct), NO_ID, np.int64)
            np.minimum.at(least, which, doc)
            files.write(f"places-{part}-{number}", lambda out, at=at, which=which: np.savez_compressed(out, at=at.astype(np.int32), which=which.astype(np.int32)))
            cuts = np.concatenate([[0], np.searchsorted(distinct, shared.value), [len(distinct)]])
            table = distinct.view(np.uint8).reshape(-1, WIDTH)
            for k in range(len(cuts) - 1):
                if cuts[k + 1] > cuts[k]:
                    same, rest = front_code(table[cuts[k] : cuts[k + 1]])
                    yield k, part, number, same.tobytes(), rest.tobytes(), least[cuts[k] : cuts[k + 1]].tobytes()

    names = ("range", "part", "run", "same", "rest", "least")

    def run(batches):
        def of(part, held):
            for row in runs(part, np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in held])).astype(U64)):
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row, strict=True)}, schema=pa.schema([(n, pa.int64()) for n in names[:3]] + [(n, pa.binary()) for n in names[3:]]))

        part, held = None, []
        for b in batches:
            for p, h in zip(b.column("part").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                if held and p != part:
                    yield from of(part, held)
                    held = []
                part = p
                held.append(h)
        if held:
            yield from of(part, held)

    dealt = found.select("part", "hashes").repartition(tasks(found), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "range long, part long, run long, same binary, rest binary, least binary")


def _spans(keys: np.ndarray, groups: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted distinct suffixes (n x WIDTH), their groups and least ids: how many spans each has, the spans (fewest and most bytes
    before the anchor that a string may start) and the least id that has the strings of a span.

    A string that starts j bytes before the anchor is LENGTH - j bytes from it on and j before it; hashes of both parts, made for all
    suffixes at once, stand for it.
    """
    low, high = np.maximum(0, LENGTH + 1 - keys[:, -2].astype(np.int64)), keys[:, -1].astype(np.int64) - 1
    counts, firsts, lasts, ids, owners = np.ones(len(keys), np.int64), [low], [high], [least], [np.arange(len(keys))]
    several = np.flatnonzero(np.bincount(groups, minlength=1)[groups] > 1)
    if len(several):
        part, own, a, b = keys[several].astype(U64) + U64(1), least[several], low[several], high[several]
        after, before = [np.zeros(len(several), U64)], [np.zeros(len(several), U64)]
        for j in range(LENGTH):
            after.append((after[-1] + part[:, j]) * U64(_STEP))
        for j in range(BEFORE):
            before.append((before[-1] + part[:, LENGTH + j]) * U64(_STEP))
        smallest = np.full((len(several), BEFORE + 3), -1, np.int64)  # a column more on either side
        for j in range(BEFORE + 1):
            some = np.flatnonzero((a <= j) & (j <= b))
            if len(some):
                h = mix(after[LENGTH - j][some] ^ mix(before[j][some] + U64(j)))
                order = np.argsort(h, kind="stable")
                h = h[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                smallest[some[order], j + 1] = np.repeat(np.minimum.reduceat(own[some[order]], first), np.diff(np.append(first, len(h))))
        inner = smallest[:, 1:-1]
        starts, ends = (inner >= 0) & (inner != smallest[:, :-2]), (inner >= 0) & (inner != smallest[:, 2:])
        row, first = np.nonzero(starts)
        counts[several] = starts.sum(1)
        single = np.ones(len(keys), bool)
        single[several] = False
        firsts, lasts, ids, owners = [low[single], first], [high[single], np.nonzero(ends)[1]], [least[single], inner[row, first]], [np.flatnonzero(single), several[row]]
    order = np.argsort(np.concatenate(owners), kind="stable")
    return counts, np.column_stack([np.concatenate(firsts), np.concatenate(lasts)])[order], np.concatenate(ids)[order]


def _merged(runs: DataFrame) -> DataFrame:
    """For each run and range the spans of its suffixes, in order."""

    def answers(rows):
        least = [np.frombuffer(r["least"], np.int64).tolist() for r in rows]
        out: list[list[tuple]] = [[] for _ in rows]
        seen = [0] * len(rows)
        keys, groups, lows, refs = [], [], [], []  # suffixes since the last close; (run, suffix) of each place

        def close():
            counts, reach, ids = _spans(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, WIDTH), np.array(groups) - groups[0], np.array(lows))
            first = np.cumsum(counts) - counts
            run, suffix = np.array(refs).T
            order = np.argsort(run, kind="stable")
            edges = np.searchsorted(run[order], np.arange(len(rows) + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = suffix[order[edges[k] : edges[k + 1]]]
                n = counts[own]
                at = np.arange(n.sum()) + np.repeat(first[own] - (np.cumsum(n) - n), n)
                out[k].append((n.astype(np.uint8), reach[at].astype(np.uint8), ids[at]))

        group = 0
        for same, run, key in merge([decode(np.frombuffer(r["same"], np.uint8), r["rest"], WIDTH) for r in rows], WIDTH):
            own = least[run][seen[run]]
            seen[run] += 1
            if same == WIDTH:
                if own < lows[-1]:
                    lows[-1] = own
            else:
                if same < GRAM:
                    group += 1
                    if len(keys) >= CLOSE:
                        close()
                        keys, groups, lows, refs = [], [], [], []
                keys.append(key), groups.append(group), lows.append(own)
            refs.append((run, len(keys) - 1))
        if keys:
            close()
        for r, parts in zip(rows, out, strict=True):
            counts, reach, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield r["part"], r["run"], r["range"], counts.tobytes(), reach.tobytes(), ids.tobytes()

    names = ("part", "run", "range", "counts", "reach", "ids")
    schema = pa.schema([(n, pa.int64()) for n in names[:3]] + [(n, pa.binary()) for n in names[3:]])

    def run(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*answers(rows), strict=True), schema.types, strict=True)], schema=schema)

        held = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["range"] != r["range"]:
                    yield batch(held)
                    held = []
                held.append(r)
        if held:
            yield batch(held)

    return runs.repartition(tasks(runs), "range").sortWithinPartitions("range", "part", "run").mapInArrow(run, "part long, run long, range long, counts binary, reach binary, ids binary")


def _cut(answers: DataFrame, parts: DataFrame, folder: str, with_text: bool) -> DataFrame:
    def cover(ids, raw, offsets, places, rows) -> np.ndarray:
        at, which = places["at"].astype(np.int64), places["which"]
        counts = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows] or [np.zeros(0, np.uint8)]).astype(np.int64)
        reach = np.concatenate([np.frombuffer(r["reach"], np.uint8) for r in rows] or [np.zeros(0, np.uint8)]).reshape(-1, 2).astype(np.int64)
        least = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows] or [np.zeros(0, np.int64)])
        first = np.cumsum(counts) - counts
        n = counts[which]
        place = np.repeat(np.arange(len(at)), n)
        span = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[which], n)
        doc = ids[np.searchsorted(offsets, at, "right") - 1]
        gone = least[span] < doc[place]
        place, span = place[gone], span[gone]
        edges = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edges, at[place] - reach[span, 1], 1)
        np.add.at(edges, at[place] - reach[span, 0] + LENGTH, -1)
        return np.cumsum(edges[:-1], dtype=np.int32) > 0

    def cut(part: int, rows: list[dict]):
        files, by_run = Files(folder), {}
        for r in rows:
            by_run.setdefault(r["run"], []).append(r)
        for number, held in enumerate(_runs(files.batches(f"texts-{part}"))):
            ids, raw, offsets = _loaded(held)
            covered = cover(ids, raw, offsets, files.arrays(f"places-{part}-{number}"), sorted(by_run.get(number, []), key=lambda r: r["range"]))
            out = []
            for doc, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                gone = covered[a:b]
                kept = raw[a:b][~gone].tobytes()
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out.append((None if doc == NO_ID else doc, b - a, int(gone.sum()), len(turns) // 2, kept if with_text else hashlib.sha256(kept).hexdigest(), turns.reshape(-1, 2).tolist() if with_text else None))
            kinds = [pa.int64()] * 4 + ([pa.binary(), pa.list_(pa.list_(pa.int64()))] if with_text else [pa.string()])
            for k in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 2000], strict=True), kinds, strict=False)], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept", "spans"] if with_text else ["kept_sha256"])]

    def run(batches):
        part, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if part is not None and r["part"] != part:
                    yield from cut(part, held)
                    held = []
                part = r["part"]
                if r["run"] is not None:
                    held.append(r)
        if part is not None:
            yield from cut(part, held)

    every = parts.select("part", *(F.lit(None).cast(t).alias(n) for n, t in (("run", "long"), ("range", "long"), ("counts", "binary"), ("reach", "binary"), ("ids", "binary"))))
    dealt = every.union(answers.select("part", "run", "range", "counts", "reach", "ids")).repartition(tasks(answers), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept binary, spans array<array<long>>" if with_text else "kept_sha256 string"))


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, and what is kept.

    with_text: kept (the remaining bytes) and spans (first and last + 1 byte of each removed run); else kept_sha256.  Null and empty
    texts, and texts under LENGTH bytes, keep everything.  Rows of one doc_id don't remove each other's bytes.  A row without
    doc_id comes after all others: it loses what they have, and nothing is lost to it.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    folder = scratch.path("suffixes")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.table(several(store_and_hash(texts, folder, _hashes)), "found")
    offers = found.filter("length(offered) > 0").select("offered").limit(4000).collect()  # a bounded sample: it only sets where ranges end
    rows = np.sort(np.frombuffer(b"".join(r["offered"] for r in offers), f"S{WIDTH}"))
    ranges = tasks(docs)
    splitters = np.unique(np.array([x[:GRAM] for x in rows[np.arange(1, ranges) * len(rows) // ranges].tolist()], f"S{GRAM}")) if len(rows) else np.zeros(0, f"S{GRAM}")
    answers = scratch.table(_merged(_sorted_runs(found, folder, splitters)), "answers")
    return _cut(answers, found.select("part").distinct(), folder, with_text)


SQL = """
WITH doc AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
piece AS (SELECT rid, doc_id, n, c, substr(h, 400 * c + 1, 500) AS h FROM (SELECT *, unnest(range(0, (n + 199) // 200)) AS c FROM doc)),
place AS (SELECT rid, doc_id, n, 200 * c + j AS i, substr(h, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(200, n - 200 * c))) AS j FROM piece)),
least AS (SELECT s, min(doc_id) AS m FROM place WHERE length(s) = 100 GROUP BY s),
byte AS (SELECT p.rid, p.i, left(p.s, 2) AS b, coalesce(max(CASE WHEN l.m < p.doc_id THEN p.i END) OVER (PARTITION BY p.rid ORDER BY p.i), -50) > p.i - 50 AS gone FROM place p LEFT JOIN least l ON l.s = p.s),
turn AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS starts FROM byte),
cut AS (SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM turn GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM doc LEFT JOIN cut USING (rid)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_text=False)
