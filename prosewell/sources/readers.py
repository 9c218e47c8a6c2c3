"""Scans: texts, JSON lines, TOML, delimited logs and sectioned markdown.  Bad input becomes findings, and reading goes on."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F

from prosewell.functions import text as T


def texts(spark: SparkSession, path: str, suffixes: str = "*.{md,txt}") -> DataFrame:
    """path, name, text of whole files of a folder (its direct children), a file or a glob; newlines and byte order mark normalised."""
    raw = spark.read.option("pathGlobFilter", suffixes).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), T.normalized(F.col("value")).alias("text"))


def literal(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def chapters(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files named chNNN with their chapter, and findings for other names."""
    numbered = files.withColumn("chapter", F.regexp_extract("name", r"^ch([0-9]{3})\.", 1).try_cast("int"))
    bad = numbered.filter("chapter IS NULL").select(F.lit("W08").alias("code"), F.col("name").alias("key"), F.lit("not named chNNN").alias("detail"))
    return numbered.filter("chapter IS NOT NULL"), bad


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records with their line (from 1), and findings: E01 for lines that aren't JSON, E02 for JSON that isn't an object."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(T.normalized(F.col("value")), "\n", -1)).alias("pos", "raw")).filter(T.trimmed(F.col("raw")) != "")
    parsed = lines.select((F.col("pos") + 1).alias("line"), "raw", F.try_parse_json("raw").isNull().alias("broken"), F.startswith(F.ltrim(F.col("raw")), F.lit("{")).alias("object"), F.from_json("raw", schema).alias("r"))
    code = F.when(F.col("broken"), "E01").otherwise("E02")
    bad = parsed.filter(F.col("broken") | ~F.col("object")).select(code.alias("code"), F.col("line").cast("string").alias("key"), F.left("raw", F.lit(40)).alias("detail"))
    return parsed.filter(~F.col("broken") & F.col("object")).select("line", "r.*"), bad


def toml_tables(spark: SparkSession, path: str, key: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the array of tables ``key`` in each TOML file, and an E01 for each file that doesn't parse.

    Ledgers of a project are few and small files; each is parsed by the task that reads it.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")

    def parse(batches):
        import json

        import pyarrow as pa

        for b in batches:
            rows = []
            for file, value in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                try:
                    rows.extend((file, json.dumps(r, ensure_ascii=False, default=str), None) for r in tomllib.loads(value.removeprefix("﻿")).get(key, []))
                except tomllib.TOMLDecodeError as e:
                    rows.append((file, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["file", "row", "error"])

    parsed = files.mapInArrow(parse, "file string, row string, error string")
    good = parsed.filter("error IS NULL").select("file", F.from_json("row", schema).alias("r")).select("file", "r.*")
    return good, parsed.filter("error IS NOT NULL").select(F.lit("E01").alias("code"), F.col("file").alias("key"), F.col("error").alias("detail"))


ENDING = r"^\s*(?:ch)?0*([0-9]+)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*$"


def endings(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chapter, head, tail of pipe-delimited rows (column ``value``), and an I05 for each other row that isn't blank or a comment."""
    rows = lines.filter(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    good = rows.filter(F.col("value").rlike(ENDING)).select(F.regexp_extract("value", ENDING, 1).cast("int").alias("chapter"), F.regexp_extract("value", ENDING, 2).alias("head"), F.regexp_extract("value", ENDING, 3).alias("tail"))
    bad = rows.filter(~F.col("value").rlike(ENDING)).select(F.lit("I05").alias("code"), F.col("value").alias("key"), F.lit("not chapter | head | tail").alias("detail"))
    return good, bad


def decisions(docs: DataFrame) -> DataFrame:
    """id, date, kind, what, why, affects of decision logs: sections headed ``## D001 2025-01-31 change``, bullets or prose below."""
    section = F.explode(F.filter(F.split(T.normalized(F.col("text")), r"(?m)^(?=## )"), lambda s: F.startswith(s, F.lit("## ")))).alias("s")
    s = F.col("s")
    bullet = lambda name: F.nullif(F.regexp_extract(s, rf"(?m)^[-*] {name}[:：]\s*(.+?)\s*$", 1), F.lit(""))
    prose = F.nullif(T.trimmed(F.regexp_replace(s, r"^## [^\n]*\n?", "")), F.lit(""))
    return docs.select(section).select(
        F.regexp_extract(s, r"^## (D[0-9]+)", 1).alias("id"), F.regexp_extract(s, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("date"), F.regexp_extract(s, r"^## [^\n]*\b(change|reject|note)\b", 1).alias("kind"),
        F.coalesce(bullet("what"), prose).alias("what"), bullet("why").alias("why"), F.filter(F.split(F.coalesce(bullet("affects"), F.lit("")), r"[,、]\s*"), lambda x: x != "").alias("affects"),
    )


def characters(files: DataFrame) -> DataFrame:
    """id, character, reading of ``# C01 name (reading)`` headings; without one, the name of the file."""
    first = F.regexp_extract("text", r"(?m)^# (.+)$", 1)
    pattern = r"^(C[0-9]+)\s+(.+?)\s*(?:[（(]([^（()）]+)[）)])?$"
    part = lambda k: F.nullif(F.regexp_extract(first, pattern, k), F.lit(""))
    return files.select(part(1).alias("id"), F.coalesce(part(2), F.regexp_replace("name", r"\.[^.]*$", "")).alias("character"), part(3).alias("reading"))


def overrides(spark: SparkSession, path: str) -> dict[str, dict]:
    """Lines of a work by rule from a JSON configuration with an ``overrides`` object; rules are few."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "overrides map<string, struct<info: double, warn: double, strong: double, target: double, off: boolean, enable: boolean, reason: string>>").alias("c")).first()
    return {rule: {k: v for k, v in lines.asDict().items() if v is not None} for rule, lines in ((row and row["c"] and row["c"]["overrides"]) or {}).items()}


def runs(spark: SparkSession, path: str) -> DataFrame:
    """created, prompt, trial, arm, path, ok and hashes of the generations of stored evaluation runs, a JSON document each."""
    schema = "created string, generations array<struct<prompt: string, hash: string, trial: int, arm: string, path: string, ok: boolean, generator: string, preamble_sha: string, response_sha: string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("created", F.explode("generations").alias("g")).select("created", "g.*")
