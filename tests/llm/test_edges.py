"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import numpy as np
import pytest

from prosewell.llm import compact_windows, decontamination, media, minhash, mixing, quality, suffix_dedup, suffix_tree_lm, token_output, url_filters

LONG = " ".join(f"w{k % 5000}" for k in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "s1"),
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "s1"),
    (2, None, None, None),
    (3, "", "en", "s2"),
    (None, "a text without an id, which is kept as it is", "en", "s2"),
    (4, " \t\n ", "fr", None),
    (5, LONG, "en", "s1"),
    (6, "one", "en", "s2"),
    (7, "The quick brown fox jumps over the lazy dog again and again", "en", "s1"),
    (8, "été “déjà” — naïve\x00 text \U0001f600 " * 5, "fr", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["score", "n", "sig", "set", "key", "a", "b", "__x", "spans", "items", "n_words", "size", "block", "held_out", "predicted", "path", "part", "a.b", "__turn", "__mix_k1", "k1", "turn", "gone", "doc.id"]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit(1).alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (7, None, 0), (None, 1, 1), (1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "brown fox jumps over the lazy"), (2, None), (None, "déjà naïve text"), (3, ""), (4, "quick brown fox jumps over the lazy dog again and again more")], "item_id long, text string")


def test_minhash(docs, none):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["component_id"] == 1 and not by[7]["kept"] and by[1]["kept"]
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[2]["component_id"] == 2
    assert by[6]["n_shingles"] == 1 and by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, 4, 5, 6, 8]))
    assert minhash.deduplicate(none).count() == 0


def test_url_filters(spark):
    urls = [(1, "http://example.org/en/12?x"), (2, None), (3, "no url"), (4, "HTTPS://Sub.EXAMPLE.org/es/"), (4, "HTTPS://Sub.EXAMPLE.org/es/"), (5, "http://a.com"), (6, "x://y.com/de/?://z"), (7, "http://notexample.org/fr/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS token", "1 AS best", "2 AS __best", "3 AS `a.b`")
    for size in (256, 0):
        got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, url_filters.RULES, plan_rules=size).collect())
        assert got == [
            (1, "example.org", "/en/12", "example.org/en/1", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
            (4, "sub.example.org", "/es/", "example.org/es/", "block"), (4, "sub.example.org", "/es/", "example.org/es/", "block"), (5, "a.com", "", None, "allow"),
            (6, "y.com", "/de/", "com/de/", "block"), (7, "notexample.org", "/fr/", "org/", "allow"),
        ]
        assert url_filters.judge(pages, url_filters.RULES, plan_rules=size).select("best", "__best", "`a.b`").distinct().collect() == [(1, 2, 3)]
    assert url_filters.judge(pages.limit(0), url_filters.RULES).count() == 0
    assert url_filters.judge(pages, []).filter("rule IS NULL AND verdict = 'allow'").count() == len(urls)


def test_suffix_tree(docs, none):
    rows = suffix_tree_lm.score_corpus(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 10 == 0)
        assert np.isfinite(r["score"]) and r["score"] < 0 and r["n_tokens"] >= 1
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert suffix_tree_lm.score_corpus(none).count() == 0


def _brute_cover(rows):
    texts = [(10**18 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(i, least.get(t[k : k + 50], 10**19))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((None if i == 10**18 else i, len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, none):
    got = suffix_dedup.remove_repeats(docs, with_text=False).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == _brute_cover(ROWS)
    full = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert bytes(full[7]["kept"]) == b"" and full[7]["spans"] == [[0, full[7]["n_bytes"]]]
    assert suffix_dedup.remove_repeats(none, with_text=False).count() == 0


def test_decontamination(docs, none, benchmark):
    rows = decontamination.find(docs, benchmark).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["items"] == ["1", "4"] and [tuple(s) for s in by[1]["spans"]] == [(1, 12)]
    assert by[8]["items"] == []  # its quotation marks are of its words
    assert by[2]["n_words"] == by[3]["n_words"] == 0
    small = {str(r["doc_id"]): r for r in decontamination.find(docs, benchmark, broadcast_bytes=0).collect()}
    assert all(small[str(r["doc_id"])]["items"] == r["items"] and small[str(r["doc_id"])]["spans"] == r["spans"] for r in rows)
    assert sorted(str(r["doc_id"]) for r in decontamination.clean(docs, benchmark).collect()).count("1") == 0
    assert decontamination.find(none, benchmark).count() == 0
    assert decontamination.clean(docs, benchmark.limit(0)).count() == len(ROWS)


def test_token_output(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_output.default_tokenizer())
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_output.digest(docs, token_output.default_tokenizer(), shard_tokens=50).collect()), key=str)
    want = []
    for i, t, *_ in ROWS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert got == sorted(want, key=str)
    assert token_output.digest(none, token_output.default_tokenizer()).count() == 0


def test_quality(docs, none, labels):
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.classify(none, labels).count() == 0
    assert all(abs(r["score"] - 0.5) < 0.2 for r in quality.classify(docs, labels.limit(0)).collect())


def test_compact_windows(docs, none):
    rows = compact_windows.linked(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["n_links"] == 0 and r["component_id"] == r["doc_id"] for r in rows)  # the repeated text is under 50 words
    more = docs.select("doc_id", "text").union(docs.filter("doc_id = 5").selectExpr("doc_id + 100", "concat('some other words first ', text)"))
    linked = {r["doc_id"]: r for r in compact_windows.linked(more).collect()}
    assert linked[105]["component_id"] == 5 and linked[105]["n_links"] == linked[5]["n_links"] == 1 and linked[105]["dup_words"] > 39_000
    assert compact_windows.linked(none).count() == 0


def test_media(docs, none):
    rows = media.digest(docs).collect()
    assert len(rows) == len(ROWS)
    want = {}
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want[i] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert all((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"]] for r in rows)
    assert media.digest(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.decide(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in rows)
    again = mixing.decide(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.decide(none).count() == 0 and mixing.mix(none).count() == 0
