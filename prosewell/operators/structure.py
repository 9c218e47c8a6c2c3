"""Structure that depends on context: outermost quotes and their roles, in-story documents, greedy windows, filled-in notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import JAPANESE, Profile
from prosewell.operators import decompose as D

#: Outermost quotes of both kinds.
QUOTES = JAPANESE.utterance + "|『[^『』]*』"
WHOLE = rf"^[\s\x{{3000}}]*(?:{QUOTES})+[\s\x{{3000}}]*$"
HEAD, SUBJECT = "(?:^|[。！？!?」』])$", "^[^、。]{1,6}[はがも]$"


def utterance_spans(docs: DataFrame, profile: Profile = JAPANESE) -> DataFrame:
    """doc_id, line, start, end: outermost quoted speech in the body of a line."""
    found = D.utterances(docs, profile)
    return found.select("doc_id", "line", F.col("pos").alias("start"), (F.col("pos") + F.length("utterance")).alias("end"))


def quote_roles(docs: DataFrame, profile: Profile = JAPANESE) -> DataFrame:
    """doc_id, line, start, role (speech or other) of outermost quotes.

    A quote is speech if it starts a sentence and closes its line, if a verb of speech follows and it starts a sentence or follows a short
    subject, or if it starts a sentence and speech follows at once.  A word that names something before it, on its line or in the last line
    that isn't all quotes, makes it other, and so does a line that brings a document; the cue holds for all whole-line quotes that follow.
    """
    lines = D.body_lines(docs).filter("kind <> 'document'")
    w = Window.partitionBy("doc_id").orderBy("line")
    told = F.when(~F.col("body").rlike(WHOLE), F.coalesce(T.trimmed(F.col("body")).rlike(f"{profile.cues['names']}|{profile.cues['brings']}"), F.lit(False)))
    lines = lines.withColumn("carried", F.coalesce(F.last(told, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    spans = lines.filter(F.col("body").rlike("[「『]")).select("doc_id", "line", "body", "carried", F.posexplode(T.offsets(F.col("body"), QUOTES)).alias("k", "s"))
    rows = D.fixed(spans, start=F.col("s.pos"), hit=F.col("s.hit"), before=T.trimmed(F.substring("body", F.lit(1), F.col("s.pos"))), after=T.trimmed(F.substring("body", F.col("s.pos") + F.length("s.hit") + 1, F.length("body"))))
    c, single = F.col, F.startswith(F.col("hit"), F.lit("「"))
    head = c("before").rlike(HEAD)
    cue = c("before").rlike(profile.cues["names"]) | ((c("before") == "") & c("carried"))
    own = F.when(cue, "other").when(c("after").rlike(profile.cues["says"]) & (head | c("before").rlike(SUBJECT)), "speech").when(single & head & (c("after") == ""), "speech").when(single & head & F.startswith(c("after"), F.lit("「")), None).otherwise("other")
    later = Window.partitionBy("doc_id", "line").orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("own", own).select("doc_id", "line", "start", F.coalesce(F.first("own", ignorenulls=True).over(later), F.lit("other")).alias("role"))


def document_blocks(docs: DataFrame, profile: Profile = JAPANESE) -> DataFrame:
    """doc_id, first, last of blocks of unindented lines in an indented manuscript that stand for documents of the story.

    A block counts after narration if it has two lines or more, or if that narration brings it.
    """
    kinds = D.kinds(docs).filter("kind NOT IN ('blank', 'heading', 'scene', 'symbol', 'docblank', 'document')")
    w = Window.partitionBy("doc_id").orderBy("line")
    rows = kinds.withColumns({"loose": ~F.col("raw").rlike(r"^[\x{3000}「『（(【〈《]"), "indents": F.max(F.when(F.col("raw").rlike(r"^\x{3000}"), 1).otherwise(0)).over(Window.partitionBy("doc_id"))}).filter("indents = 1")
    turned = rows.withColumns({"run": F.sum(F.when(F.lag("loose").over(w).eqNullSafe(F.col("loose")), 0).otherwise(1)).over(w), "intro": F.lag("raw").over(w)})
    runs = turned.filter("loose").groupBy("doc_id", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n"), F.min_by("intro", "line").alias("intro"))
    return runs.filter("intro IS NOT NULL").filter((F.col("n") >= 2) | F.col("intro").rlike(profile.cues["brings"])).select("doc_id", "first", "last")


def guessed_blocks(docs: DataFrame, profile: Profile = JAPANESE, most: int = 3) -> DataFrame:
    """doc_id, line, lines: in a manuscript without indentation, lines that bring a document and how many lines right after may be of it."""
    kinds = D.kinds(docs).filter("kind NOT IN ('blank', 'heading', 'scene', 'symbol', 'docblank')")
    rows = kinds.withColumn("indents", F.max(F.when(F.col("raw").rlike(r"^\x{3000}"), 1).otherwise(0)).over(Window.partitionBy("doc_id"))).filter("indents = 0")
    w = Window.partitionBy("doc_id").orderBy("line")
    fits = lambda k: F.coalesce((F.lead("line", k).over(w) == F.col("line") + k) & (F.lead("kind", k).over(w) != "document") & ~F.lead("raw", k).over(w).rlike(r"^[\s\x{3000}「『]"), F.lit(False))
    rows = rows.withColumns({f"f{k}": fits(k) for k in range(1, most + 1)})
    n = F.lit(0)
    for k in range(most, 0, -1):
        n = F.when(F.col(f"f{k}"), n + 1).otherwise(0)
    return rows.filter((F.col("kind") != "document") & T.trimmed(F.col("raw")).rlike(profile.cues["brings"])).select("doc_id", "line", n.cast("bigint").alias("lines")).filter("lines > 0")


def sentence_prefix(text: Column, pos: Column) -> Column:
    """What stands between the start of a sentence and a place (from 0)."""
    return F.regexp_extract(F.left(text, pos), r"[^。！？!?\n]*$", 0)


def in_open_quote(text: Column, pos: Column) -> Column:
    """Whether a quote is open at a place: more openers than closers on its line before it."""
    line = F.regexp_extract(F.left(text, pos), r"[^\n]*$", 0)
    return F.regexp_count(line, F.lit("[「『]")) > F.regexp_count(line, F.lit("[」』]"))


def crowded_windows(utterances: DataFrame, width: int = 300, least: int = 14) -> DataFrame:
    """doc_id, at: places (pos) of windows of ``width`` characters with ``least`` utterances or more, each begun after the last one's end.

    The window of each utterance comes from a range frame; which are reported is a fold over the few that are full.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(-width, 0)
    full = utterances.withColumns({"n": F.count("*").over(w), "start": F.min("pos").over(w)}).filter(F.col("n") >= least)
    gathered = full.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("start").cast("bigint").alias("start")))).alias("w"))
    zero = F.struct(F.lit(-1).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.when(x["start"] > s["last"], F.struct(x["pos"].alias("last"), F.concat(s["out"], F.array(x["start"])).alias("out"))).otherwise(s)
    return gathered.select("doc_id", F.explode(F.aggregate("w", zero, step)["out"]).alias("at"))


def filled_items(notes: DataFrame) -> DataFrame:
    """id, filled: lines of a note with a value: bullets and ``key: value`` lines that have one, table rows below their head and rule."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)<!--.*?-->", "")
    rows = notes.select("id", F.posexplode(F.split(clean, "\n", -1)).alias("line", "raw")).withColumn("t", T.trimmed(F.col("raw")))
    table = F.startswith(F.col("t"), F.lit("|"))
    inside = F.lag(table).over(Window.partitionBy("id").orderBy("line"))
    bare = T.trimmed(F.regexp_replace("t", r"^[-*・\s\x{3000}]+", ""))
    value = F.when(bare.rlike("[:：]"), T.trimmed(F.regexp_replace(bare, "^[^:：]*[:：]", ""))).otherwise(bare)
    counted = F.when((F.col("t") == "") | F.startswith(F.col("t"), F.lit("#")), 0).when(F.col("table"), F.when(F.coalesce("inside", F.lit(False)) & ~F.col("t").rlike(r"^[|:\-\s]*$"), 1).otherwise(0)).when(value == "", 0).otherwise(1)
    return rows.withColumns({"table": table, "inside": inside}).groupBy("id").agg(F.sum(counted).cast("bigint").alias("filled"))


def section(text: Column, title: str) -> Column:
    """The body of one ``##`` section, comments removed; empty if there is none."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", "")
    return T.trimmed(F.regexp_extract(clean, rf"(?ms)^##[ \t]*{title}[ \t]*\n(.*?)(?=^##\s|\z)", 1))


def last_events(lines: DataFrame) -> DataFrame:
    """id, result, tools: text of the last result event and the number of tool events of a log of JSON lines; other lines don't matter."""
    parsed = lines.select("id", "pos", F.from_json("raw", "type string, result string").alias("e"))
    return parsed.groupBy("id").agg(F.max_by(F.when(F.col("e.type") == "result", F.col("e.result")), F.when(F.col("e.type") == "result", F.col("pos"))).alias("result"), F.count_if(F.col("e.type") == "tool_use").alias("tools"))

