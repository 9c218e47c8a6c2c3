from pyspark.sql import functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import JAPANESE
from prosewell.operators import conversion, decompose, lint, rules
from prosewell.plans.base import manuscripts
from prosewell.sources import readers, sinks
from prosewell.streaming import lint as streaming


def test_texts_and_chapters(spark, tmp_path):
    for name, text in (("ch001.md", "﻿a\r\nb"), ("notes.txt", "x"), ("skip.csv", "y")):
        (tmp_path / name).write_text(text, newline="")
    files = readers.texts(spark, str(tmp_path))
    assert sorted((r["name"], r["text"]) for r in files.collect()) == [("ch001.md", "a\nb"), ("notes.txt", "x")]
    good, bad = readers.chapters(files)
    assert [r["chapter"] for r in good.collect()] == [1] and [r["key"] for r in bad.collect()] == ["notes.txt"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "facts.jsonl").write_text('{"id": "F1", "ch": 2}\n\nnot json\n[1]\n{"id": "F2"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "facts.jsonl"), "id string, ch int")
    assert sorted((r["line"], r["id"], r["ch"]) for r in good.collect()) == [(1, "F1", 2), (5, "F2", None)]
    assert sorted((r["code"], r["key"]) for r in bad.collect()) == [("E01", "3"), ("E02", "4")]


def test_toml_tables(spark, tmp_path):
    (tmp_path / "a.toml").write_text('[[item]]\nid = "F1"\nmax_gap = 3\n[[item]]\nid = "F2"\n')
    (tmp_path / "b.toml").write_text("broken = [")
    good, bad = readers.toml_tables(spark, str(tmp_path / "*.toml"), "item", "id string, max_gap int")
    assert sorted((r["id"], r["max_gap"]) for r in good.collect()) == [("F1", 3), ("F2", None)]
    assert [(r["code"], r["key"]) for r in bad.collect()] == [("E01", "b.toml")]


def test_logs(spark):
    good, bad = readers.endings(spark.createDataFrame([("ch003 | scene | line",), ("# note",), ("broken",), ("4|a|b",)], "value string"))
    assert sorted(tuple(r) for r in good.collect()) == [(3, "scene", "line"), (4, "a", "b")] and bad.count() == 1
    log = "# Log\n## D001 2025-01-31 change\n- what: x\n- why: y\n- affects: ch1, ch2\n## D002 2025-02-01 note\nfree prose"
    rows = {r["id"]: r for r in readers.decisions(spark.createDataFrame([(log,)], "text string")).collect()}
    assert rows["D001"]["affects"] == ["ch1", "ch2"] and rows["D001"]["kind"] == "change" and rows["D002"]["what"] == "free prose" and rows["D002"]["why"] is None
    people = readers.characters(spark.createDataFrame([("a.md", "# C01 Mori (もり)"), ("b.md", "no heading")], "name string, text string")).collect()
    assert [tuple(r) for r in people] == [("C01", "Mori", "もり"), (None, "b", None)]


def test_sinks(spark, tmp_path):
    docs, options = manuscripts(spark, "/root/testdata/sf0.001"), conversion.Options("pixiv")
    assert sinks.converted(docs, options, str(tmp_path / "out")).count() == 0
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == docs.count() and written.filter("out LIKE '%[[rb:%'").count()
    found = spark.createDataFrame([(k, "R01", "WARN", 1.0) for k in range(9)] + [(1, "N01", "FAIL", 1.0)], "doc_id long, rule string, severity string, value double")
    rows = sinks.report(found, 3).collect()
    assert [(r["rule"], r["n"], r["places"]) for r in rows] == [("N01", 1, "1"), ("R01", 9, "0, 1, 2")]
    blocks = spark.createDataFrame([(1, 0, "b", "two"), (0, 0, "a", "one")], "priority int, block int, heading string, body string")
    sinks.pack(blocks, str(tmp_path / "pack"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "pack"), wholetext=True).collect())
    assert text.startswith("## a\none\n\n## b\ntwo\n<!-- sha256 ")
    sinks.results(spark.createDataFrame([("p", "A"), ("p", "A"), ("p", "tie")], "prompt string, result string"), str(tmp_path / "results"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "results/tally")).collect()] == ["| p | A | 2 |", "| p | tie | 1 |"]
    sinks.lint_json(spark.createDataFrame([("L01", 0.5)], "rule string, info double"), str(tmp_path / "lint"))
    assert spark.read.json(str(tmp_path / "lint")).first()["rule"] == "L01"


def test_configuration(spark, tmp_path):
    (tmp_path / "lint.json").write_text('{"overrides": {"L01": {"info": 0.6, "reason": "dense"}, "R01": {"off": true}}}')
    found = readers.overrides(spark, str(tmp_path / "lint.json"))
    assert found == {"L01": {"info": 0.6, "reason": "dense"}, "R01": {"off": True}}
    assert rules.Lines(overrides=found).of("L01") == (0.6, 0.4, None) and not rules.Lines(overrides=found).on("R01")
    assert rules.parse_range("1500") == (1350, 1650, 1310) and rules.parse_range("9-1") is None and rules.Lines(direct=True).on("K08") is False


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("doc_id < 20")
    docs.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    streaming.watch(stream, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(got, key=str) == sorted(map(tuple, lint.lint(docs).collect()), key=str)


def test_newlines_marks_and_sums(spark):
    """Line ends and byte order marks don't matter, counts add up over lines, run lengths add up to sentences."""
    text = "One two. Three!\nFour five, six."
    rows = spark.createDataFrame([(1, text), (2, "﻿" + text.replace("\n", "\r\n")), (3, text.replace("\n", "\r"))], "doc_id long, text string")
    assert len({r["raw"] for r in decompose.lines(rows).filter("line = 2").collect()}) == 1
    whole = rows.select("doc_id", T.visible(T.normalized(F.col("text"))).alias("n"))
    lines = decompose.lines(rows).groupBy("doc_id").agg(F.sum(T.visible(F.col("raw"))).alias("m"))
    assert whole.join(lines, "doc_id").filter("n <> m").count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert decompose.runs(docs).agg(F.sum("length")).first()[0] == decompose.sentences(docs).count()


def test_speech_breaks_runs_and_tags_do_not(spark):
    plain, spoken = "　雨だ。風だ。\n　空だ。海だ。", "　雨だ。風だ。\n「うん」\n　空だ。海だ。"
    tagged = "　雨だ。風だ。\n「うん」と言った。空だ。海だ。"
    rows = spark.createDataFrame([(1, plain), (2, spoken), (3, tagged)], "doc_id long, text string")
    runs = {k: [r["length"] for r in decompose.runs(rows, JAPANESE).filter(F.col("doc_id") == k).orderBy("run").collect()] for k in (1, 2, 3)}
    assert runs == {1: [4], 2: [2, 2], 3: [4]}
