"""Connected components by alternating large-star and small-star.

Each round is two groupings of the edge list; edges only ever point to smaller nodes, and the rounds end when nothing moves.  Minima
are combined before the shuffle, so a node with very many edges costs a partial minimum in each task and a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prosewell.llm.scratch import Scratch


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v) with m, the least node among u and all v of u."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v")


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v; longs) but the least of its component, which is its component.

    Loops and repeated edges don't matter.  No edges give no rows.
    """
    now = scratch.table(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        after = scratch.table(small_star(large_star(now).distinct()).distinct(), f"{name}-{k}")
        state, before = _state(after), state
        scratch.drop(f"{name}-{k - 1}")
        now = after
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
