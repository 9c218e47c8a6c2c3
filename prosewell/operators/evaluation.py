"""Blind pairwise evaluation and calibration: balanced order, agreement of swapped judgements, tallies; alarm lines from figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prosewell.operators.stats import rounded


def text_hash(text: Column, size: int = 12) -> Column:
    return F.left(F.sha2(F.regexp_replace(text, r"^\s+|\s+$", ""), 256), F.lit(size))


def assign(pairs: DataFrame, key: str, seed: str) -> DataFrame:
    """Half of the pairs flipped, by the order of seeded hashes within cells of hashes, so no global sort is needed.

    Pairs of one cell (the first hash digits, more with more pairs) alternate; a cell is off balance by one pair at most.
    """
    hashed = pairs.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    digits = cell_digits(pairs.count())
    turn = F.row_number().over(Window.partitionBy(F.left(F.col("h"), F.lit(digits))).orderBy("h"))
    return hashed.withColumn("flipped", turn % 2 == 0).drop("h")


def cell_digits(n: int, cell: int = 100_000) -> int:
    """Hash digits that make cells of so many pairs at most."""
    digits = 1
    while n > cell * 16**digits:
        digits += 1
    return digits


def settle(first: Column, second: Column) -> Column:
    """Of two judgements in swapped orders: failed if one is missing, undecided, the label if they agree, else unstable."""
    return F.when(first.isNull() | second.isNull(), "failed").when((first == "tie") | (second == "tie"), "undecidable").when(first == second, first).otherwise("unstable")


def verdict(text: Column) -> Column:
    """A or B from the last non-empty line ``PREFERENCE: X``, if it isn't quoted, indented or within a fence."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    last = F.try_element_at(lines, F.lit(-1))
    fences = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("```"))))
    found = F.regexp_extract(last, r"^PREFERENCE: (A|B|tie)\s*$", 1)
    return F.when((fences % 2 == 0) & (found != ""), found)


#: Reasons in the order in which they are told; the last only if asked for strictly.
REASONS = ("missing", "not ok", "text changed", "prompt changed", "preamble changed", "other command", "empty", "other tree")


def validity(record: dict[str, Column], strict: bool = False) -> Column:
    """First of REASONS why a stored generation can't be used, null if it can.  Pairs of hashes that a record doesn't have aren't compared."""
    differs = lambda a, b: ~record[a].eqNullSafe(record[b]) if a in record and b in record else F.lit(False)
    tests = (
        record["path"].isNull(), ~record["ok"], differs("response_sha", "actual_sha"), differs("prompt_sha", "prompt_now"), differs("preamble_sha", "preamble_now"), differs("command", "expected_command"),
        F.length(F.trim(record["text"])) == 0, differs("tree", "tree_now") & F.lit(strict),
    )
    out = F.when(tests[0], REASONS[0])
    for test, name in zip(tests[1:], REASONS[1:], strict=True):
        out = out.when(test, name)
    return out


def blocks(sentences: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, block, cv: variation of sentence lengths in whole blocks of ``size``; an incomplete last block is left out."""
    numbered = sentences.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "idx")) - 1) / size))
    return numbered.groupBy("doc_id", "block").agg(F.count("*").alias("n"), (F.stddev_pop("chars") / F.avg("chars")).alias("cv")).filter(F.col("n") == size).select("doc_id", "block", rounded(F.col("cv")).alias("cv"))


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group and a column for each share q: the value of index int(q * (n - 1) + 0.5) in order, by counts of distinct values, so no group is gathered."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group)
    ranked = counted.withColumns({"upto": F.sum("k").over(w.orderBy("v")), "n": F.sum("k").over(w)})
    place = lambda q: F.floor(q * (F.col("n") - 1) + 0.5)
    return ranked.groupBy(group).agg(*(F.min(F.when(F.col("upto") > place(q), F.col("v"))).alias(name) for name, q in shares.items()))


#: How far from the mean alarm lines are set.
LOWER_SD, LOWER_FLOOR = (1, 2), (0.85, 0.7)
UPPER_SD, UPPER_FLOOR = (1, 2), (1.15, 1.3)


def alarm_lines(figures: DataFrame, rule: str, value: str, lower: bool, least: int = 3) -> DataFrame:
    """rule, n, mean, info, warn from the figures of approved documents; rules of fewer than ``least`` are left out."""
    m, sd = F.avg(value), F.stddev_pop(value)
    pick, sign = (F.greatest, -1) if lower else (F.greatest, 1)
    floors = LOWER_FLOOR if lower else UPPER_FLOOR
    lines = [rounded(pick(m + sign * k * sd, f * m)) for k, f in zip(LOWER_SD if lower else UPPER_SD, floors, strict=True)]
    return figures.groupBy(rule).agg(F.count(value).alias("n"), rounded(m).alias("mean"), lines[0].alias("info"), lines[1].alias("warn")).filter(F.col("n") >= least)


#: How far from the mean the alarm lines of densities are set, and least shares of the lines they had.
DENSITY_SD, DENSITY_FLOOR, OLD_SHARE = (1, 2), (1.15, 1.3), (0.5, 0.75)


def density_lines(figures: DataFrame, rule: str, value: str, old: dict[str, tuple], manual: dict[str, dict] | None = None, off: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """rule, n, info, warn of densities: above the mean, never far under the lines they had; rules that are off by contract are left out, manual lines win."""
    m, sd = F.avg(value), F.stddev_pop(value)
    rows = figures.filter(~F.col(rule).isin(*off)) if off else figures
    rows = rows.groupBy(rule).agg(F.count(value).alias("n"), m.alias("m"), sd.alias("sd")).filter(F.col("n") >= least)
    floors = F.create_map(*(x for k, (info, warn, _) in sorted(old.items()) for x in (F.lit(k), F.lit(0.5 * (info or warn or 1.0)))))
    floor = F.coalesce(F.try_element_at(floors, F.col(rule)), F.lit(0.5))
    own = {k: v for k, v in (manual or {}).items()}
    given = lambda name, c: F.coalesce(F.try_element_at(F.create_map(*(x for k, v in sorted(own.items()) if name in v for x in (F.lit(k), F.lit(float(v[name]))))), F.col(rule)), c) if any(name in v for v in own.values()) else c
    info = rounded(F.greatest(F.col("m") + F.col("sd"), 1.15 * F.col("m"), floor))
    warn = rounded(F.greatest(F.col("m") + 2 * F.col("sd"), 1.3 * F.col("m"), 1.5 * floor))
    return rows.select(rule, "n", given("info", info).alias("info"), given("warn", warn).alias("warn"))


def dialogue_target(figures: DataFrame, value: str, least: int = 3) -> DataFrame:
    """target, tolerance of dialogue: the mean, and two deviations or 0.1."""
    row = figures.agg(F.count(value).alias("n"), rounded(F.avg(value)).alias("target"), rounded(F.greatest(F.lit(0.1), 2 * F.stddev_pop(value))).alias("tolerance"))
    return row.filter(F.col("n") >= least).drop("n")


def judgment(record: dict[str, Column]) -> Column:
    """The stored preference if everything it was made from is still the same; null otherwise."""
    same = record["ok"] & record["preference"].isNotNull() & (record["request_sha"] == record["request_now"]) & (record["judge"] == record["judge_now"]) & (record["verdict_sha"] == record["verdict_now"])
    return F.when(same & verdict(record["verdict_text"]).eqNullSafe(record["preference"]), record["preference"])


def tree_hash(files: DataFrame, tree: str, path: str, sha: str, size: int = 16) -> DataFrame:
    """tree, hash: one hash of the paths and hashes of a tree's files, in the order of the paths.  A tree is a working copy, some thousand files."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(path).alias("path"), F.col(sha).alias("sha")))), lambda x: F.concat(x["path"], F.lit("\0"), x["sha"]))
    return files.groupBy(tree).agg(F.left(F.sha2(F.array_join(lines, "\n"), 256), F.lit(size)).alias("hash"))


def load_prompts(prompts: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prompts (name, base, text) with the text of the base they name before their own, and an error for each that names one that isn't there."""
    joined = prompts.alias("p").join(bases.alias("b"), F.col("p.base") == F.col("b.name"), "left")
    good = joined.filter(F.col("p.base").isNull() | F.col("b.name").isNotNull()).select("p.name", F.concat_ws("\n", "b.text", "p.text").alias("text"))
    return good, joined.filter(F.col("p.base").isNotNull() & F.col("b.name").isNull()).select("p.name", F.col("p.base").alias("missing"))


def pivoted(findings: DataFrame) -> DataFrame:
    """doc_id and for each severity its diagnostics, locations and rules."""
    return findings.groupBy("doc_id").pivot("severity", ["FAIL", "STRONG", "WARN", "INFO"]).agg(F.count(F.lit(1)).alias("diagnostics"), F.sum("hits").alias("locations"), F.array_sort(F.collect_set("rule")).alias("rules"))


def audited(expected: DataFrame, logs: DataFrame, forbidden: str) -> DataFrame:
    """key, missing, hits: expected logs that aren't there, and how often a name that must not be seen stands in those that are."""
    return expected.join(logs, "key", "left").select("key", F.col("text").isNull().alias("missing"), F.coalesce(F.regexp_count("text", F.lit(forbidden)), F.lit(0)).alias("hits"))
