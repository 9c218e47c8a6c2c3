"""Sinks: findings as JSON, text only after its conversion was inverted and found equal, capped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prosewell.operators import conversion
from prosewell.operators import rules as R


def findings_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("errorifexists").json(path)


def report(findings: DataFrame, cap: int = 5) -> DataFrame:
    """rule, severity, n and the first ``cap`` places of each rule, the gravest first; the places are the cap's only object."""
    least = F.expr(f"slice(array_sort(collect_list(doc_id)), 1, {int(cap)})")
    # each task keeps its first places only, so a rule with many findings sends few
    part = findings.select("rule", "severity", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)).alias("cell"))
    cells = part.groupBy("rule", "severity", "cell").agg(F.count("*").alias("n"), least.alias("ids"))
    halves = cells.groupBy("rule", "severity", F.col("cell").bitwiseAND(255).alias("half")).agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, cap).alias("ids"))
    whole = halves.groupBy("rule", "severity").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, cap).alias("ids"))
    return whole.select("rule", "severity", "n", F.array_join(F.col("ids").cast("array<string>"), ", ").alias("places")).orderBy(R.rank(F.col("severity")), "rule")


def converted(docs: DataFrame, options: conversion.Options, path: str) -> DataFrame:
    """Writes doc_id and the text of each document in the notation of a target as Parquet, unless one doesn't come back: then writes nothing and returns what differs."""
    made = conversion.convert_text(docs, options).select("doc_id", "out")
    wrong = conversion.verify(docs, made, options)
    if wrong.isEmpty():
        made.write.mode("errorifexists").parquet(path)
    return wrong


def lint_json(overrides: DataFrame, path: str) -> None:
    """rule and its lines (info, warn, strong, reason), one JSON object a rule."""
    overrides.coalesce(1).write.mode("overwrite").json(path)


def pack(blocks: DataFrame, path: str) -> None:
    """The blocks (priority, block, heading, body) of a pack as markdown with the digest of what it holds at its end.  A pack is bounded by its budget."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "block", "heading", "body"))), lambda b: F.concat(F.lit("## "), b["heading"], F.lit("\n"), b["body"])), "\n\n")
    rows = blocks.agg(text.alias("text"))
    rows.select(F.concat("text", F.lit("\n<!-- sha256 "), F.sha2("text", 256), F.lit(" -->")).alias("value")).write.mode("errorifexists").text(path)


def results(rows: DataFrame, path: str) -> None:
    """Results as JSON, and a table of the tally of each prompt (never totalled) beside it."""
    rows.write.mode("errorifexists").json(f"{path}/results")
    rows.groupBy("prompt", "result").agg(F.count("*").alias("n")).orderBy("prompt", "result").select(F.concat(F.lit("| "), "prompt", F.lit(" | "), "result", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("value")).write.mode("errorifexists").text(f"{path}/tally")
