"""Counting conventions, grids and pages.  All are sums over line rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prosewell.functions import text as T
from prosewell.operators import decompose as D


#: Set emphasis aside while ruby is rendered.
LEFT, RIGHT = "\ue000", "\ue001"


def count_modes(docs: DataFrame) -> DataFrame:
    """doc_id, body, narou, raw, invisible.

    body: visible characters of prose; narou: of all but headings; raw: all characters and line ends, without markup and trailing
    line ends.  An empty document has zeros.
    """
    text = F.regexp_replace(T.normalized(F.col("text")), r"\n+$", "")
    rows = D.kinds(docs.select("doc_id", text.alias("text")))
    body = T.document_body(F.col("raw"))
    prose = F.col("kind").isin("dialogue", "bracket", "narration") | ((F.col("kind") == "document") & ~T.is_symbols(T.trimmed(body)))
    bare = T.plain(F.when(F.col("kind") == "heading", T.heading_title(body)).otherwise(body))
    counted = rows.groupBy("doc_id").agg(
        F.sum(F.when(prose, T.visible(T.plain(body))).otherwise(0)).alias("body"), F.sum(F.when(F.col("kind") != "heading", T.visible(T.plain(body))).otherwise(0)).alias("narou"),
        (F.sum(F.length(bare)) + F.count("*") - 1).alias("raw"),
    )
    invisible = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[\p{Cf}\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]")).alias("invisible"))
    return counted.join(invisible, "doc_id")


def rows_for(cells: Column, width: int, hang: bool = False) -> Column:
    """Rows that a string takes at ``width`` cells; an empty one takes one.

    hang: a stop or comma right after a full row stays on it.
    """
    n = F.length(cells)
    if not hang:
        return F.greatest(F.lit(1), F.ceil(n / width).cast("int"))
    start = F.struct(F.lit(0).alias("rows"), F.lit(0).alias("used"))
    step = lambda s, c: (
        F.when((s["used"] == width) & c.isin("、", "。") & (s["rows"] > 0), F.struct(s["rows"].alias("rows"), F.lit(width + 1).alias("used")))
        .when((s["rows"] == 0) | (s["used"] >= width), F.struct((s["rows"] + 1).alias("rows"), F.lit(1).alias("used")))
        .otherwise(F.struct(s["rows"].alias("rows"), (s["used"] + 1).alias("used")))
    )
    return F.when(n == 0, 1).otherwise(F.aggregate(F.split(cells, ""), start, step)["rows"])


def grid_pages(docs: DataFrame, width: int, height: int, pair_marks: bool = False, hang: bool = False, indent: bool = False) -> DataFrame:
    """doc_id, rows, pages, last_rows: lines flowed into a grid.

    pair_marks: a pair of marks is one cell.  hang: a stop right after a full row stays on it.  indent: narration without an indentation
    of its own is counted as if it had one.
    """
    text = F.regexp_replace(T.normalized(F.col("text")), r"\n+$", "")
    rows = D.kinds(docs.select("doc_id", text.alias("text")).filter("text <> ''"))
    body = T.document_body(F.col("raw"))
    bare = F.when(F.col("kind").isin("blank", "docblank"), "").otherwise(T.plain(F.when(F.col("kind") == "heading", T.heading_title(body)).otherwise(body)))
    cells = F.regexp_replace(bare, "[!?！？]{2}", "!") if pair_marks else bare
    if indent:
        cells = F.when((F.col("kind") == "narration") & ~body.rlike(r"^[\s\x{3000}]"), F.concat(F.lit("　"), cells)).otherwise(cells)
    flowed = rows.groupBy("doc_id").agg(F.sum(rows_for(cells, width, hang)).cast("bigint").alias("rows"))
    all_ = docs.select("doc_id").join(flowed, "doc_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    pages = F.ceil(F.col("rows") / height)
    return all_.select("doc_id", "rows", pages.alias("pages"), F.when(F.col("rows") == 0, 0).otherwise(F.col("rows") - (pages - 1) * height).alias("last_rows"))


def parse_grid(spec: str) -> tuple[int, int] | None:
    """Width and height of "20x10"; null if it can't be read or one of them is zero."""
    import re

    m = re.fullmatch(r"\s*([1-9][0-9]*)\s*[xX×]\s*([1-9][0-9]*)\s*", spec or "")
    return (int(m[1]), int(m[2])) if m else None


def bounds(counts: DataFrame, column: str, low: int | None, high: int | None) -> DataFrame:
    """doc_id, value, status (in, under, over), short_by."""
    v = F.col(column)
    status = F.when(v < low, "under").when(v > high, "over").otherwise("in")
    return counts.select("doc_id", v.alias("value"), status.alias("status"), F.when(v < low, low - v).when(v > high, v - high).otherwise(0).alias("off_by"))


def bare_ruby(docs: DataFrame) -> DataFrame:
    """doc_id, n: rubies without a bar, which no count takes for markup."""
    left = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), T.EMPHASIS, ""), T.RUBY, "")
    return docs.select("doc_id", F.regexp_count(left, F.lit(T.BARE_RUBY)).cast("bigint").alias("n"))


def totals(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sums by key and one over all, whose key is null."""
    return rows.rollup(key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def convert_lines(docs: DataFrame, target: str, emphasis_mark: str = "﹅") -> DataFrame:
    """doc_id, line, out: inline markup of each line in the notation of a target."""
    return D.lines(docs).select("doc_id", "line", render(F.col("raw"), target, emphasis_mark).alias("out"))


def render(line: Column, target: str, emphasis_mark: str = "﹅", strip: bool = False) -> Column:
    """Emphasis first, then ruby, neither looked at again: emphasis is set aside in private-use characters meanwhile."""
    left, right = LEFT, RIGHT
    aside = F.regexp_replace(line, T.EMPHASIS, f"{left}$1{right}")
    ruby = {"alphapolis": "#$1__$2__#", "pixiv": "[[rb:$1 > $2]]", "plain_paren": "$1（$2）", "plain_drop": "$1", "plain_bare": "$1"}.get(target)
    done = F.regexp_replace(aside, T.RUBY, ruby) if ruby else aside
    shown = "$1" if strip else {"pixiv": (r"[[emphasismark:$1>" + emphasis_mark + "]]"), "plain_drop": "$1"}.get(target, "《《$1》》")
    return F.regexp_replace(done, f"{left}([^{right}]*){right}", shown)


def unrender(line: Column, target: str) -> Column:
    """The inverse of ``render`` for targets that lose nothing."""
    if target == "alphapolis":
        return F.regexp_replace(line, r"#([^#\n]+?)__([^#\n]+?)__#", "｜$1《$2》")
    if target == "pixiv":
        back = F.regexp_replace(line, r"\[\[rb:\s*(.+?)\s*>\s*(.+?)\s*\]\]", "｜$1《$2》")
        return F.regexp_replace(back, r"\[\[emphasismark:(.+?)>.\]\]", "《《$1》》")
    return line
