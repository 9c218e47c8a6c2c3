"""Statistics of documents, as folds over the arrays of ``decompose.document``: one scan, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import LATIN, Profile
from prosewell.operators import decompose as D


def rounded(c: Column, digits: int = 3) -> Column:
    """A double rounded as the SQL does it: the product with a power of ten is, half away from zero.  F.round takes the shortest decimal instead (0.575 to 0.58)."""
    scale = float(10**digits)
    return F.round(c * scale) / scale


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: s + x)


def number_of(rows: Column, hit) -> Column:
    return F.size(F.filter(rows, hit)).cast("bigint")


def mean(numbers: str) -> Column:
    """Of an array column; null without values."""
    n = F.size(numbers)
    return F.when(n > 0, total(F.col(numbers)) / n)


def spread(numbers: str, average: str) -> Column:
    """Population deviation over the mean (a column); null for fewer than two values."""
    n = F.size(numbers)
    squares = F.aggregate(F.col(numbers), F.lit(0.0), lambda s, x: s + (x - F.col(average)) * (x - F.col(average)))
    return F.when(n >= 2, F.sqrt(squares / n) / F.nullif(F.col(average), F.lit(0.0)))


def middle(numbers: str) -> Column:
    """The median of a sorted array column."""
    n = F.size(numbers)
    at = lambda k: F.get(F.col(numbers), k.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def figures(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """``decompose.document`` with the figures of ``doc_stats`` and: told (sentences that count), narration (narration paragraphs), lens, para_lens."""
    rows = D.fixed(
        D.document(docs, profile),
        told=F.filter("sents", lambda s: ~s["tag"]), narration=F.filter("paras", lambda p: p["kind"] == "narration"),
    )
    rows = D.fixed(
        rows, lens=F.sort_array(F.transform("told", lambda s: s["chars"])), para_lens=F.transform("narration", lambda p: p["chars"]), chars=total(F.transform("paras", lambda p: p["chars"])),
        narration_chars=total(F.transform("paras", lambda p: p["narr_chars"])), sentences=F.size("told").cast("bigint"), narration_paragraphs=F.size("narration").cast("bigint"),
    )
    rows = D.fixed(rows, sentence_mean=mean("lens"), para_mean=mean("para_lens"))
    n = F.nullif(F.col("sentences"), F.lit(0))
    known = F.filter("runs", lambda r: r["value"] != "other")
    share = lambda name: rounded(number_of(F.col("told"), lambda s: s["cls"] == name) / n)
    one = number_of(F.col("narration"), lambda p: F.size(p["sents"]) <= 1)
    return D.fixed(
        rows,
        dialogue_ratio=rounded(total(F.transform("paras", lambda p: F.when(p["utterances"] > 0, p["chars"] - p["narr_chars"] - 2 * p["utterances"]).otherwise(0))) / F.nullif(F.col("chars"), F.lit(0))),
        sentence_len_mean=rounded(F.col("sentence_mean"), 1), sentence_len_median=middle("lens").cast("double"), sentence_len_cv=rounded(spread("lens", "sentence_mean")), sentence_len_max=F.try_element_at("lens", F.lit(-1)),
        sentences_le10=number_of(F.col("lens"), lambda x: x <= 10), sentences_ge80=number_of(F.col("lens"), lambda x: x >= 80), commas_per_sentence=rounded(total(F.transform("told", lambda s: s["commas"])) / n, 2),
        ta_rate=share(profile.past), keitai=F.coalesce(share(profile.polite) >= 0.5, F.lit(False)) if profile.polite else F.lit(False),
        same_ending_max_run=F.coalesce(F.array_max(F.transform(known, lambda r: r["length"])), F.lit(0).cast("bigint")),
        same_ending_run_share=rounded(total(F.transform(F.filter(known, lambda r: r["length"] >= 4), lambda r: r["length"])) / n),
        paragraph_len_mean=rounded(F.col("para_mean"), 1), paragraph_len_cv=rounded(spread("para_lens", "para_mean")), one_sentence_paragraph_rate=rounded(one / F.nullif(F.col("narration_paragraphs"), F.lit(0))),
        utterances=total(F.transform("paras", lambda p: p["utterances"])), kanji_ratio=rounded(total(F.transform("paras", lambda p: F.regexp_count(p["body"], F.lit("[一-龥々〆]")))) / F.nullif(F.col("chars"), F.lit(0))),
    ).drop("sentence_mean", "para_mean")


STATS = (
    "chars", "narration_chars", "dialogue_ratio", "sentences", "sentence_len_mean", "sentence_len_median", "sentence_len_cv", "sentence_len_max", "sentences_le10", "sentences_ge80", "commas_per_sentence", "ta_rate",
    "keitai", "same_ending_max_run", "same_ending_run_share", "narration_paragraphs", "paragraph_len_mean", "paragraph_len_cv", "one_sentence_paragraph_rate", "utterances", "kanji_ratio",
)


def doc_stats(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """A row for each document: doc_id and STATS; figures without a base are null, counts 0."""
    return figures(docs, profile).select("doc_id", *STATS)


def ending_share(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """doc_id, cls, share of the sentences of a document."""
    classes = F.transform("told", lambda s: s["cls"])
    rows = D.fixed(D.fixed(D.document(docs, profile), told=F.filter("sents", lambda s: ~s["tag"])), classes=classes)
    found = F.transform(F.array_distinct("classes"), lambda c: F.struct(c.alias("cls"), rounded(F.size(F.filter("classes", lambda x: x == c)) / F.size("classes")).alias("share")))
    return rows.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


def uniform_stretches(docs: DataFrame, profile: Profile = LATIN, size: int = 5, within: float = 0.25) -> DataFrame:
    """doc_id, hits, first: stretches of ``size`` sentences whose lengths are all within 25 % of their mean, taken greedily without overlap."""
    rows = D.fixed(D.document(docs, profile), told=F.filter("sents", lambda s: ~s["tag"]))
    rows = D.fixed(rows, full=uniform_starts("told", size, within))
    return rows.select("doc_id", greedy("full", size).alias("taken")).filter(F.size("taken") > 0).select("doc_id", F.size("taken").cast("bigint").alias("hits"), F.get("taken", F.lit(0)).alias("first"))


def uniform_starts(sents: str, size: int, within: float) -> Column:
    """Places (from 0) where ``size`` sentences of an array column are that alike."""
    at = lambda i: F.get(F.col(sents), i)["chars"]

    def alike(i):
        some = [at(i + k) for k in range(size)]
        average = sum(some[1:], some[0]) / size
        return (F.least(*some) >= average * (1 - within)) & (F.greatest(*some) <= average * (1 + within))

    return F.when(F.size(sents) >= size, F.filter(F.sequence(F.lit(0), F.greatest(F.size(sents) - size, F.lit(0))), alike)).otherwise(F.array().cast("array<int>"))


def greedy(places: str, size: int) -> Column:
    """Of ascending places in an array column those that don't overlap, the first first."""
    start = F.struct(F.lit(-size).alias("last"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.col(places), start, lambda s, x: F.when(x >= s["last"] + size, F.struct(x.alias("last"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s))["out"]


def repeats_in_window(docs: DataFrame, pattern: str, limit: int, window: int) -> DataFrame:
    """doc_id, word, pos: first place where a word comes for the ``limit``-th time within ``window`` characters."""
    hits = docs.select("doc_id", F.explode(T.offsets(F.col("text"), pattern)).alias("x")).select("doc_id", F.lower("x.hit").alias("word"), F.col("x.pos").alias("pos"))
    span = F.col("pos") - F.lag("pos", limit - 1).over(Window.partitionBy("doc_id", "word").orderBy("pos"))
    return hits.withColumn("span", span).filter(F.col("span") <= window).groupBy("doc_id", "word").agg(F.min("pos").alias("pos"))


#: Lengths of runs, lines of variation, and what counts as a short or long utterance, in the measures of a corpus.
RUN_LENGTHS, CV_LINES, SHORT_SAID, LONG_SAID = (3, 4, 5, 6, 8), (0.40, 0.42, 0.50), 10, 60
SPLIT = "」[^「」\n]{1,20}。「"


def block_spreads(numbers: str, size: int, digits: int = 3) -> Column:
    """Population deviation over the mean of each whole block of ``size`` values of an array column; an incomplete last block is left out."""
    n = F.floor(F.size(numbers) / size).cast("int")
    block = lambda k: F.slice(numbers, k * size + 1, F.lit(size))

    def spread_of(values: Column) -> Column:
        average = total(values) / size
        return rounded(F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - average) * (x - average)) / size) / F.nullif(average, F.lit(0.0)), digits)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: spread_of(block(k)))).otherwise(F.array().cast("array<double>"))


def measures(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """A row a document of what alarm lines are measured from: runs of each length for 10000 characters of narration, blocks of 20 sentences and
    of 10 paragraphs with shares under each line, short and long utterances, and speech that narration splits."""
    rows = D.fixed(figures(docs, profile), in_order=F.transform("told", lambda s: s["chars"]), said=F.flatten(F.transform("paras", lambda p: F.transform(F.regexp_extract_all(p["body"], F.lit(profile.utterance), F.lit(0)), lambda u: T.visible(u) - 2))))
    rows = D.fixed(rows, blocks=block_spreads("in_order", 20), para_blocks=block_spreads("para_lens", 10, 9))
    base = F.nullif(F.col("narration_chars"), F.lit(0))
    known = F.filter("runs", lambda r: ~r["value"].isin("other", profile.noun))
    per = [rounded(number_of(known, lambda r: r["length"] >= k) * 10000 / base, 1).alias(f"runs{k}") for k in RUN_LENGTHS]  # noqa: B023
    under = [rounded(number_of(F.col("blocks"), lambda x: x < line) / F.nullif(F.size("blocks"), F.lit(0))).alias(f"under{round(100 * line)}") for line in CV_LINES]  # noqa: B023
    n = F.nullif(F.size("said"), F.lit(0))
    return rows.select(
        "doc_id", *per, F.size("blocks").cast("bigint").alias("blocks"), *under, F.size("para_blocks").cast("bigint").alias("para_blocks"), rounded(F.aggregate("para_blocks", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("para_blocks"), F.lit(0))).alias("para_cv"),
        rounded(number_of(F.col("said"), lambda x: x <= SHORT_SAID) / n).alias("short_said"), rounded(number_of(F.col("said"), lambda x: x >= LONG_SAID) / n).alias("long_said"), total(F.transform("paras", lambda p: F.regexp_count(p["body"], F.lit(SPLIT)))).alias("split"),
    )
