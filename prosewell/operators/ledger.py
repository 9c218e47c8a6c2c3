"""Ledgers: constraints as anti joins, windows and conditions; as-of lookups; packs within a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

Finding = ("code", "key", "detail")


def finding(rows: DataFrame, code: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def required(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A finding for each named column that is null or blank in a row; one scan."""
    blank = lambda c: F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c))
    missing = F.explode(F.filter(F.array(*map(blank, columns)), lambda x: x.isNotNull()))
    return finding(rows.select(key, missing.alias("missing")), "E02", F.col(key), F.col("missing"))


def outside(rows: DataFrame, key: str, column: str, allowed: list) -> DataFrame:
    """Values that aren't among the allowed ones."""
    return finding(rows.filter(~F.col(column).isin(allowed)), "E03", F.col(key), F.col(column))


def orphans(rows: DataFrame, key: str, reference: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """References without a parent; null references don't count."""
    left = rows.filter(F.col(reference).isNotNull()).join(parents.select(F.col(parent_key).alias("parent")).alias("parents"), F.col(reference) == F.col("parents.parent"), "left_anti")
    return finding(left, "E04", F.col(key), F.col(reference))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, counted before they are compared."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Numbers between the least and largest of a group that no row has."""
    ends = rows.groupBy(group).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    every = ends.select(group, F.explode(F.sequence("lo", "hi")).alias(number))
    return every.join(rows.select(group, number).distinct(), [group, number], "left_anti")


def last_before(rows: DataFrame, group: str, at: str) -> DataFrame:
    """As-of: for each row the last earlier ``at`` of its group, and how long ago."""
    before = F.max(at).over(Window.partitionBy(group).orderBy(at).rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).withColumn("gap", F.col(at) - F.col("before"))


def latest(rows: DataFrame, keys: list[str], at: str, tie: str, limit: Column | None = None) -> DataFrame:
    """The row of the largest ``at`` (then ``tie``) of each key, of those with at < limit."""
    kept = rows.filter(F.col(at) < limit) if limit is not None else rows
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return kept.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def as_of(rows: DataFrame, group: str, order: str, chapter: str, before: int) -> DataFrame:
    """Rows of a log up to a chapter: a row without a chapter of its own (a child) goes with the last one that has one."""
    since = F.last(chapter, ignorenulls=True).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("since", since).filter(F.col("since").isNull() | (F.col("since") < before))


def trailing_equal(rows: DataFrame, group: str, order: list[str], value: str, n: int) -> DataFrame:
    """Groups whose last n rows have one value: group, value."""
    w = Window.partitionBy(group).orderBy(*map(F.desc, order))
    tail = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return tail.groupBy(group).agg(F.count("*").alias("k"), F.count_distinct(value).alias("kinds"), F.min(value).alias("value")).filter((F.col("k") == n) & (F.col("kinds") == 1)).select(group, "value")


def flat(rows: DataFrame, group: str, order: list[str], value: str, within: float) -> DataFrame:
    """Rows that with the two before them lie within a span, not all of them zero."""
    w = Window.partitionBy(group).orderBy(*order)
    three = [F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w)]
    spans = rows.withColumns({"__a": three[1], "__b": three[2]})
    own = [F.col(value), F.col("__a"), F.col("__b")]
    span = F.greatest(*own) - F.least(*own)
    return spans.filter(F.col("__b").isNotNull() & (span <= within) & (F.greatest(*own) > 0)).drop("__a", "__b")


def without_reason(overrides: DataFrame, reason: str) -> DataFrame:
    """Overrides that don't say why."""
    return overrides.filter(F.col(reason).isNull() | (F.trim(F.col(reason)) == ""))


def same_head(rows: DataFrame, key: str, name: str) -> DataFrame:
    """First characters that several names share, with the names."""
    return rows.select(F.upper(F.left(F.col(name), F.lit(1))).alias("head"), key).groupBy("head").agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def pack(blocks: DataFrame, group: str, budget: int) -> DataFrame:
    """Blocks (priority, size, droppable) of each group that stay: whole blocks go from the largest priority down until the rest fits.

    What isn't droppable stays even over the budget.
    """
    fixed = F.sum(F.when(F.col("droppable"), 0).otherwise(F.col("size"))).over(Window.partitionBy(group))
    running = F.sum(F.when(F.col("droppable"), F.col("size")).otherwise(0)).over(Window.partitionBy(group).orderBy("priority", "block"))
    return blocks.withColumns({"__fixed": fixed, "__running": running}).filter(~F.col("droppable") | (F.col("__fixed") + F.col("__running") <= budget)).drop("__fixed", "__running")


def source_hash(rows: DataFrame, group: str, name: str, body: str) -> DataFrame:
    """One digest of a group's rows: rows lie in 256 cells by the hash of their name, a cell's digest is over its rows in order, the group's over its cells."""
    named = F.col(name).cast("string")
    one = F.struct(named.alias("name"), F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("sha"))
    cells = rows.select(group, F.left(F.sha2(named, 256), F.lit(2)).alias("cell"), one.alias("one")).groupBy(group, "cell").agg(F.sort_array(F.collect_list("one")).alias("ones"))
    lines = F.transform("ones", lambda x: F.concat(x["name"], F.lit(":"), x["sha"]))
    digests = cells.select(group, "cell", F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "sha"))), lambda x: x["sha"]), "\n")
    return digests.groupBy(group).agg(F.sha2(joined, 256).alias("digest"))


def misnumbered(files: DataFrame, name: str, number: str) -> DataFrame:
    """Files whose chapter isn't that of their name, and chapters that several files have."""
    told = F.regexp_extract(name, r"^ch([0-9]{3})\.", 1).try_cast("int")
    wrong = finding(files.filter(F.coalesce(told != F.col(number), F.lit(True))), "E05", F.col(name), F.col(number))
    twice = files.groupBy(number).agg(F.count("*").alias("n")).filter("n > 1")
    return wrong.union(finding(twice, "E05", F.concat(F.lit("chapter "), F.col(number).cast("string")), F.col("n")))


def maintained(items: DataFrame, handled: DataFrame, touches: DataFrame, key: str, at: str, open_states: list[str]) -> DataFrame:
    """Threads that are open and that nothing has handled, with the last place that touched them (null if none)."""
    last = touches.groupBy(key).agg(F.max(at).alias("last"))
    return items.filter(F.col("status").isin(open_states)).join(handled.select(key).distinct(), key, "left_anti").join(last, key, "left")


def relevant_facts(facts: DataFrame, cast: list, chapter: int) -> DataFrame:
    """Facts before a chapter that no other fact before it supersedes, and that are of the cast, of the last two chapters, or proposed."""
    before = facts.filter(F.col("ch") < chapter)
    gone = before.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct()
    related = F.arrays_overlap("chars", F.array(*map(F.lit, cast))) | (F.col("ch") >= chapter - 2) | (F.col("status") == "proposed")
    return before.join(gone, "id", "left_anti").filter(F.coalesce(related, F.lit(False)))


def decisions_for(decisions: DataFrame, keys: list, last: int = 5) -> DataFrame:
    """Decisions that affect one of the keys, and the last few whatever they affect; each once."""
    own = decisions.filter(F.arrays_overlap("affects", F.array(*map(F.lit, keys))))
    latest_ = decisions.orderBy(F.desc("date"), F.desc("id")).limit(last)
    return own.unionByName(latest_).distinct()


def lacking(filled: DataFrame, needs: dict[str, int]) -> DataFrame:
    """name, filled, needed: required material with fewer filled items than it must have; a pack is refused while there is any."""
    wanted = filled.sparkSession.createDataFrame(sorted(needs.items()), "name string, needed int")
    got = wanted.join(filled, "name", "left").withColumn("filled", F.coalesce("filled", F.lit(0).cast("bigint")))
    return got.filter("filled < needed").select("name", "filled", "needed")


def ordered(findings: DataFrame, level: Column) -> DataFrame:
    """Findings by level, code and place."""
    return findings.withColumn("level", level).orderBy("level", "code", "key")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
