"""Documents to lines, paragraphs, sentences and utterances.

``document`` keeps all of them as arrays in the row of their document, so figures of a document are folds over its own arrays and
need no shuffle.  The other functions give one of the arrays as rows.  A text is taken apart in steps, each a transform that names
what the next one looks at, so nothing is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import LATIN, MARK, Profile

BODY = ("dialogue", "bracket", "narration", "document")


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns, computed once: what reads them later, or filters by them, finds them made."""
    keep = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("made")
    return df.select(*(F.col(f"`{c}`") for c in keep), made).select(*(F.col(f"`{c}`") for c in keep), "made.*")


def _with(rows: Column, keep: tuple[str, ...], **more) -> Column:
    """Structs with fields of their own besides those kept; ``more`` are functions of the struct."""
    return F.transform(rows, lambda s: F.struct(*(s[k].alias(k) for k in keep), *(f(s).alias(n) for n, f in more.items())))


def _lines(text: Column) -> Column:
    """line (from 1), raw, body0 (without document mark), kind."""
    rows = F.transform(F.split(T.normalized(text), "\n", -1), lambda r, i: F.struct((i + 1).alias("line"), r.alias("raw"), T.document_body(r).alias("body0")))
    rows = _with(rows, ("line", "raw", "body0"), bare=lambda s: T.trimmed(s["body0"]))
    return _with(rows, ("line", "raw", "body0"), kind=lambda s: T.line_kind(s["raw"], s["body0"], s["bare"]))


def _bodies(lines: Column) -> Column:
    """Prose and documents: line, raw, kind, body (without inline markup), chars."""
    rows = _with(F.filter(lines, lambda s: s["kind"].isin(*BODY)), ("line", "raw", "kind"), body=lambda s: T.plain(s["body0"]))
    return _with(rows, ("line", "raw", "kind", "body"), chars=lambda s: T.visible(s["body"]))


def _paragraphs(bodies: Column, profile: Profile) -> Column:
    """line, raw, kind (narration, dialogue, mixed, document, silent), body, chars, marked, narr, narr_chars, utterances, sents."""
    keep = ("line", "raw", "body", "chars")
    told = lambda s: F.when(s["kind"] == "document", "document").when(~T.has_letters(s["body"]), "silent")
    rows = _with(bodies, (*keep, "kind"), told=told)
    rows = _with(rows, (*keep, "told"), marked=lambda s: F.when(s["told"].isNull(), T.marked(s["body"], profile)).otherwise(""))
    rows = _with(rows, (*keep, "told", "marked"), narr=lambda s: F.replace(s["marked"], F.lit(MARK), F.lit("")), utterances=lambda s: T.marks(s["marked"]))
    rows = _with(rows, (*keep, "told", "marked", "narr", "utterances"), narr_chars=lambda s: T.visible(s["narr"]))
    opens = lambda s: T.trimmed(s["body"]).rlike("^[「『]") if profile.name == "ja" else F.lit(False)
    kind = lambda s: F.coalesce(s["told"], F.when((s["narr_chars"] == 0) & (s["utterances"] > 0), "dialogue").when((s["utterances"] > 0) | opens(s), "mixed").otherwise("narration"))
    rows = _with(rows, (*keep, "marked", "narr", "narr_chars", "utterances"), kind=kind)
    pieces = lambda s: F.when(s["kind"].isin("narration", "mixed"), F.regexp_extract_all(s["marked"], F.lit(profile.sentence), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return _with(rows, (*keep, "kind", "marked", "narr", "narr_chars", "utterances"), sents=lambda s: _sentences(s, pieces(s), profile))


def _sentences(para: Column, pieces: Column, profile: Profile) -> Column:
    """line, idx, sentence, tag, chars, end, cls, commas of pieces of two visible characters or more."""
    rows = F.transform(pieces, lambda p, i: F.struct(para["line"].alias("line"), i.alias("idx"), p.rlike(profile.tag).alias("tag"), T.trimmed(F.replace(p, F.lit(MARK), F.lit(""))).alias("sentence")))
    keep = ("line", "idx", "tag", "sentence")
    rows = F.filter(_with(rows, keep, chars=lambda s: T.visible(s["sentence"])), lambda s: s["chars"] >= 2)
    rows = _with(rows, (*keep, "chars"), end=lambda s: T.sentence_end(s["sentence"], profile))
    return _with(rows, (*keep, "chars"), cls=lambda s: T.ending_class(s["end"], profile), commas=lambda s: F.regexp_count(s["sentence"], F.lit(profile.comma)))


def _tokens(lines: Column, paras: Column) -> Column:
    """What runs of endings are made of, in order: {line, value}; speech and documents break them (D), sentences that only tell who spoke don't count."""
    of_para = lambda p: F.when(p["kind"].isin("dialogue", "document"), F.array(F.struct(p["line"].alias("line"), F.lit("D").alias("value")))).otherwise(F.transform(F.filter(p["sents"], lambda s: ~s["tag"]), lambda s: F.struct(s["line"].alias("line"), s["cls"].alias("value"))))
    breaks = F.transform(F.filter(lines, lambda s: F.startswith(s["raw"], F.lit(T.DOCUMENT_MARK))), lambda s: F.struct(s["line"].alias("line"), F.lit("D").alias("value")))
    own = F.flatten(F.transform(paras, of_para))
    # without marked lines the paragraphs are in order already
    return F.when(F.size(breaks) == 0, own).otherwise(_in_line_order(own, breaks))


def _in_line_order(tokens: Column, breaks: Column) -> Column:
    placed = F.transform(F.concat(tokens, breaks), lambda t, i: F.struct(t["line"].alias("line"), i.alias("at"), t["value"].alias("value")))
    return F.transform(F.array_sort(placed), lambda t: F.struct(t["line"].alias("line"), t["value"].alias("value")))


def islands(values: str, equal) -> tuple[Column, Column]:
    """Starts (from 0) of maximal runs in an array column by name, and where each ends; equal(a, b) says that two neighbours are of one run."""
    n = F.size(values)
    at = lambda i: F.get(F.col(values), i)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | ~equal(at(i - 1), at(i)))).otherwise(F.array().cast("array<int>"))
    return starts, n


def runs_of(values: str, starts: str, fields) -> Column:
    """A struct for each run: run (from 1), length, and fields(first element)."""
    at = lambda i: F.get(F.col(values), i)
    end = lambda k: F.coalesce(F.get(F.col(starts), k + 1), F.size(values))
    return F.transform(F.col(starts), lambda s, k: F.struct((k + 1).cast("bigint").alias("run"), (end(k) - s).cast("bigint").alias("length"), s.alias("at"), *fields(at(s))))


def document(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """A row a document: doc_id, lines, paras (silent ones included), sents (those that tell who spoke included), runs of endings."""
    rows = fixed(docs.select("doc_id", "text"), lines=_lines(F.col("text"))).drop("text")
    rows = fixed(rows, paras=_paragraphs(_bodies(F.col("lines")), profile))
    rows = fixed(rows, sents=F.flatten(F.transform("paras", lambda p: p["sents"])), tokens=_tokens(F.col("lines"), F.col("paras")))
    starts, _ = islands("tokens", lambda a, b: a["value"] == b["value"])
    rows = fixed(rows, starts=starts)
    found = runs_of("tokens", "starts", lambda t: (t["value"].alias("value"), t["line"].alias("first")))
    return fixed(rows, runs=F.filter(found, lambda r: r["value"] != "D")).drop("tokens", "starts")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), raw."""
    return docs.select("doc_id", F.posexplode(F.split(T.normalized(F.col("text")), "\n", -1)).alias("pos", "raw")).select("doc_id", (F.col("pos") + 1).alias("line"), "raw")


def kinds(docs: DataFrame) -> DataFrame:
    """doc_id, line, raw, kind."""
    return docs.select("doc_id", F.explode(_lines(F.col("text"))).alias("s")).select("doc_id", "s.line", "s.raw", "s.kind")


def body_lines(docs: DataFrame) -> DataFrame:
    """Lines of prose and documents, without document marks and inline markup: doc_id, line, kind, body, chars."""
    return docs.select("doc_id", F.explode(_bodies(_lines(F.col("text")))).alias("s")).select("doc_id", "s.line", "s.kind", "s.body", "s.chars")


def _para_rows(docs: DataFrame, profile: Profile) -> DataFrame:
    return docs.select("doc_id", F.explode(_paragraphs(_bodies(_lines(F.col("text"))), profile)).alias("p"))


def paragraphs(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """doc_id, line, kind (narration, dialogue, mixed, document), chars, narr_chars, utterances, n_sent, body, narr."""
    rows = _para_rows(docs, profile).filter("p.kind <> 'silent'")
    return rows.select("doc_id", "p.line", "p.kind", "p.chars", "p.narr_chars", "p.utterances", F.size("p.sents").alias("n_sent"), "p.body", "p.narr")


def all_sentences(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Sentences of narration and of the narration around speech: doc_id, line, idx, tag, sentence, chars, cls, commas."""
    return _para_rows(docs, profile).select("doc_id", F.explode("p.sents").alias("s")).select("doc_id", "s.*")


def sentences(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """``all_sentences`` without those that only tell who spoke."""
    return all_sentences(docs, profile).filter("NOT tag").drop("tag")


def runs(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Maximal runs of sentences of one ending: doc_id, run, value, length, first line."""
    return document(docs, profile).select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.run", "r.value", "r.length", "r.first")


def utterances(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """doc_id, line, idx, pos, utterance: outermost quoted stretches of the body."""
    found = body_lines(docs).filter(F.col("body").rlike(profile.quotes)).filter(F.col("body").rlike(profile.utterance))
    return found.select("doc_id", "line", F.posexplode(T.offsets(F.col("body"), profile.utterance)).alias("idx", "x")).select("doc_id", "line", "idx", F.col("x.pos").alias("pos"), F.col("x.hit").alias("utterance"))


def in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("line", "idx")


def row_runs(rows: DataFrame, value: str, order: tuple[str, ...] = ("line", "idx")) -> DataFrame:
    """Maximal runs of one value among rows of a table, in the order of a document: doc_id, run, value, length, first line."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    turned = rows.withColumn("turn", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    return turned.withColumn("run", F.sum("turn").over(w)).groupBy("doc_id", "run", F.col(value).alias("value")).agg(F.count("*").alias("length"), F.min(order[0]).alias("first"))
