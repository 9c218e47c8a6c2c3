"""Mixing sources to target weights by pivotal dependent rounding.

Built-in functions throughout.  Every document of a source gets the whole part of target / source size as copies; the fractions
that remain are paired, and words move from one of a pair to the other at random until one of them is whole.  What is left over
in a block of documents is combined again, block of blocks by block of blocks, as in a reduction tree, so each source comes within
one document of its target however large it is, and no task ever holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prosewell.llm.scratch import Scratch, free_name, quoted

#: Documents of a block, on average; the fold over one block runs in one task.
BLOCK = 512
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)

_ITEM = "struct<order: bigint, rnd: double, k: string, size: bigint, p: double, doc: struct<doc_id: bigint, k1: bigint, k2: bigint>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, n, source_size) to the same with target and ratio.

    Weights go to the sources by code point, null last, repeating.  A target is min(max_repeats * size, level * weight), where the
    level makes the targets add up to the size of everything: the fixed point of sharing the excess again by weight.  One row a
    source, so the windows over all of them stay small.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * max_repeats
    everything, rising = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    stepped = (
        ranked.withColumn("cap", cap.cast("double"))
        .withColumns({"total": F.sum("source_size").over(everything).cast("double"), "all_w": F.sum("w").over(everything)})
        .withColumns({"cap_before": F.coalesce(F.sum("cap").over(rising), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(rising), F.lit(0.0))})
        .withColumn("level_here", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
        .withColumn("level", F.max("level_here").over(everything))  # it rises as long as sources are capped, and falls after
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    ratio = F.when(F.col("source_size") == 0, 0.0).when(F.col("capped"), float(max_repeats)).otherwise(F.col("target") / F.col("source_size"))
    return stepped.withColumn("target", target).withColumn("ratio", ratio).select("source", "n", "source_size", "target", "ratio")


def _fold(items: str) -> Column:
    """Sequential pivotal rounding of an array of items: {carry, out}; all of ``out`` is whole, ``carry`` may be fractional.

    Items come from the largest to the smallest: a large one is settled against those near its size, and what stays open is small.
    """
    room, back = "(1 - s.carry.p)", "(x.p * x.size / s.carry.size)"
    give, take = "s.carry.p", "((1 - x.p) * x.size / s.carry.size)"
    up = f"(x.rnd * (least({room}, {back}) + least({give}, {take})) < least({give}, {take}))"
    item = lambda of, p: f"named_struct('order', {of}.order, 'rnd', {of}.rnd, 'k', {of}.k, 'size', {of}.size, 'p', cast({p} AS double), 'doc', {of}.doc)"
    step = lambda carry, done: f"named_struct('carry', {carry}, 'out', concat(s.out, array({done})))"
    moved = "s.carry.size / x.size"
    return F.expr(f"""
        aggregate({items}, named_struct('carry', cast(null AS {_ITEM}), 'out', cast(array() AS array<{_ITEM}>)), (s, x) -> CASE
            WHEN x.size = 0 OR x.p = 0 THEN {step("s.carry", item("x", "0"))}
            WHEN s.carry IS NULL THEN named_struct('carry', {item("x", "x.p")}, 'out', s.out)
            WHEN {up} AND {room} <= {back} THEN {step(item("x", f"greatest(0, x.p - {room} * {moved})"), item("s.carry", "1"))}
            WHEN {up} THEN {step(item("s.carry", f"least(1, s.carry.p + {back})"), item("x", "0"))}
            WHEN {give} <= {take} THEN {step(item("x", f"least(1, x.p + {give} * {moved})"), item("s.carry", "0"))}
            ELSE {step(item("s.carry", f"greatest(0, s.carry.p - {take})"), item("x", "1"))} END)""")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _rounded(items: DataFrame, groups: Column, level: int, seed: int) -> DataFrame:
    """items(source, k, size, p, doc) to one row a block: (source, block, carry, out)."""
    rnd = _uniform(F.lit(seed + 2 * level), "source", "k")
    block = F.pmod(F.xxhash64(F.lit(seed + 2 * level + 1), "k"), groups).cast("bigint")
    packed = items.select("source", block.alias("block"), F.struct((-F.col("size")).alias("order"), rnd.alias("rnd"), "k", "size", "p", "doc").alias("item"))
    return packed.groupBy("source", "block").agg(F.sort_array(F.collect_list("item")).alias("items")).select("source", "block", _fold("items").alias("f")).select("source", "block", "f.carry", "f.out")


def decide(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK, seed: int = 20) -> DataFrame:
    """(doc_id, k1, k2, size, source_size, target, copies) for each row of ``docs`` (doc_id, text, source).

    k1 and k2 are hashes of the row's columns; equal rows have equal ones, and each of them has its own line in the result.
    Null text has size 0, takes nothing and is never paired; a null source is a source, the last; null ids are kept.  Randomness
    comes from row hashes alone, so a rerun decides alike.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    columns = [quoted(c) for c in sorted(docs.columns)]
    sized = scratch.table(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), *columns).alias("k1"), F.xxhash64(F.lit(seed + 1), *columns).alias("k2")),
        "sized",
    )
    sources = scratch.table(source_targets(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, max_repeats).withColumn("parts", F.ceil(F.col("n") / block)), "sources")
    with_source = lambda df: df.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    first = with_source(sized).select("d.source", F.concat_ws("-", "d.k1", "d.k2", "d.doc_id").alias("k"), "d.size", (F.col("ratio") - F.floor("ratio")).alias("p"), F.struct("d.doc_id", "d.k1", "d.k2").alias("doc"), "parts")
    blocks = scratch.table(_rounded(first, F.col("parts"), 1, seed), "blocks1")

    decided, level = [], 1
    carried = blocks.filter("carry IS NOT NULL").select("source", F.col("block").cast("string").alias("k"), "carry.size", "carry.p", "carry.doc")
    parts = (sources.agg(F.max("parts")).first()[0] or 0) if not sized.isEmpty() else 0  # one number
    while parts > 1:
        level, parts = level + 1, -(-parts // block)
        upper = scratch.table(_rounded(carried, F.lit(parts), level, seed), f"blocks{level}")
        decided.append(upper.select("source", F.explode("out").alias("x")).select("source", F.col("x.k").cast("bigint").alias("block"), F.col("x.p").alias("take")))
        carried = upper.filter("carry IS NOT NULL").select("source", "carry.k", "carry.size", "carry.p", "carry.doc")
    last = carried.select("source", F.col("k").cast("bigint").alias("block"), (_uniform(F.lit(seed), "source", "k") < F.col("p")).cast("double").alias("take"))
    fate = last
    for part in decided:
        fate = fate.unionByName(part)
    left = blocks.filter("carry IS NOT NULL").alias("b").join(fate.alias("f"), F.col("b.source").eqNullSafe(F.col("f.source")) & (F.col("b.block") == F.col("f.block"))).select("b.source", "b.carry.doc", "b.carry.size", F.col("f.take").alias("take"))
    done = blocks.select("source", F.explode("out").alias("x")).select("source", "x.doc", "x.size", F.col("x.p").alias("take"))
    copies = (F.floor("ratio") + F.col("take")).cast("bigint")
    return with_source(done.unionByName(left)).select("d.doc.doc_id", "d.doc.k1", "d.doc.k2", "d.size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK, seed: int = 20) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns stay.  Rows of size 0 take part with their whole copies."""
    names = docs.columns
    k1, k2, total, rows, nth, own, copy = (free_name(x, names) for x in ("k1", "k2", "total", "rows", "nth", "own", "copy"))
    columns = [quoted(c) for c in sorted(names)]
    totals = decide(docs, weights, max_repeats, block, seed).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.sum("copies").alias(total), F.count("*").alias(rows))
    keyed = docs.withColumns({k1: F.xxhash64(F.lit(seed), *columns), k2: F.xxhash64(F.lit(seed + 1), *columns)}).join(totals, [k1, k2])
    turn = F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1))
    times = F.floor(F.col(total) / F.col(rows)) + (F.col(nth) <= F.col(total) % F.col(rows)).cast("bigint")
    spread = keyed.withColumn(nth, turn).withColumn(own, times.cast("int")).filter(F.col(own) > 0)
    return spread.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(own)))).select(*map(quoted, names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return decide(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
