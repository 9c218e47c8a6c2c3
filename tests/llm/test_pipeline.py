"""Each stage of the pipeline against a plain version of it, on its own input."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from prosewell.llm import minhash, mixing, quality, token_output

DATA = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def _words(text):
    return (text or "").encode().lower().split()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = before, docs
        assert k == 4 or docs.columns == NAMES

    before, after = kept["quality_classifier"]
    scores = quality.query(spark, DATA).toPandas()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(scores[scores.predicted == 1].doc_id)

    before, after = kept["minhash_near_dedup"]
    sets = {}
    for r in before.collect():
        w = _words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d in sets if find(d) == d)

    before, after = kept["benchmark_decontamination"]
    clean = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t or "").encode().lower().split()
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = clean(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    hit = {r["doc_id"] for r in before.collect() if any(tuple(w[i : i + n]) in windows for w in [clean(r["text"])] for n in sizes for i in range(len(w) - n + 1))}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({r["doc_id"] for r in before.collect()} - hit)

    before, after = kept["mixing_sources"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.decide(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, n in copies.items() for _ in range(n))

    before, after = kept["token_output"]
    tokenizer, start = Tokenizer.from_file(token_output.default_tokenizer()), 0
    want = []
    for r in sorted(before.collect(), key=lambda r: (r["doc_id"], r["text"])):
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in after.collect()) == want


def test_a_batch_of_texts_takes_little_memory_of_a_worker():
    """The arrays over the bytes of a batch of 8 MB, as the first two stages make them."""
    import tracemalloc

    import pyarrow as pa

    from prosewell.llm import minhash, quality, tokens

    texts = [" ".join(f"w{(i * 7919 + k) % 99991}" for k in range(600)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for limit, most in ((tokens.SLICE, 40), (tokens.CHUNK, 400)):
        tracemalloc.start()
        sizes = [(quality.features(*tokens.text_bytes(p.column("text"))).shape[0], len(minhash.shingle_sets(*tokens.text_bytes(p.column("text"))))) for p in tokens.slices([batch], limit=limit)]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert sum(a for a, _ in sizes) == sum(b for _, b in sizes) == len(texts)
        assert peak < most


def test_the_fit_needs_no_second_worker_beside_the_one_that_makes_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 5)), rng.integers(0, 2, 200)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, __x array<double>")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)] + [(3, int(y[3])), (None, 1), (4, None)], "doc_id long, quality int")

    def second(*_):
        raise AssertionError("a Python function beside the one that makes the vectors")

    monkeypatch.setattr(type(vectors), "mapInArrow", second)
    got = quality.fit(vectors, labels)
    known = [i for i in [*range(200), 3] if zlib.crc32(str(i).encode()) % quality.FOLDS]
    x, y = x[known], y[known]
    want = quality.fit_sums({k: (float((y == k).sum()), x[y == k].sum(0), x[y == k].T @ x[y == k]) for k in (0, 1)})
    for name in ("mean", "half", "log_det", "log_prior", "center", "scale"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-9, atol=1e-12), name


def test_texts_stay_where_they_are_when_near_duplicates_go(spark, monkeypatch):
    """Few ids go to the texts, not the texts to the ids; many are joined by exchange, with the same rows."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text + " x"), (3, "a text of its own words"), (3, "another text of id three"), (3, "a text of its own words"), (None, text), (None, text), (5, None), (5, None), (2, text), (2, "of id two that goes as a whole")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = minhash.deduplicate(docs)
        plan = few._jdf.queryExecution().executedPlan().toString()
        got = few.collect()
        monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
        many = minhash.deduplicate(docs).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    want = [(1, text), (3, "a text of its own words"), (3, "another text of id three"), (None, text), (None, text), (5, None)]
    assert order(got) == order(many) == order(want)
    assert "SortMergeJoin" not in plan
