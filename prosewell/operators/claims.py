"""Claims about counts in a text: quoted words and the number of characters or morae said of them, dates, verse, nearby quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prosewell.functions import text as T
from prosewell.operators import decompose as D

#: Forms of numbers that ``parse_number`` reads, units that are counted, and days of the week.
NUMBER = r"(?:[0-9０-９]+|[〇一二三四五六七八九十百]+|ひと|ふた)"
UNIT = "(文字|字|拍|音)"
WEEKDAYS = "月火水木金土日"
_WORD = "「([^「」]{1,40})」"
#: A word and then its number; the number first, with a noun for the word between; a number taken back for another; a word without quotes.
FORWARD = rf"{_WORD}(?:は|という)?[^「」。]{{0,10}}?({NUMBER}){UNIT}"
REVERSE = rf"({NUMBER}){UNIT}の(?:言葉|名前|単語|合言葉)[^「」。]{{0,6}}{_WORD}"
CORRECTED = rf"{_WORD}(?:は|という)?[^「」。]{{0,10}}?{NUMBER}(?:文字|字|拍|音)(?:では|じゃ)なく、?({NUMBER}){UNIT}"
BARE = rf"([ァ-ヺー]{{2,12}}|[一-龥々]{{2,8}})(?:は|も)({NUMBER})(文字|字)"
#: What makes a claim somebody's guess, a condition, or something that is only being counted.
UNSURE = "(?:かもしれない|だろう|らしい|そうだ|はずだ|と思|と聞|ではない|じゃない|[か？?]$)"
SKIP = "(?:なら|たら|れば|(?:^|[、「　])もし|数え直|数えると|数えてみ)"
TAKEN_BACK = "^[　\\s]*(?:いや|いいや|ちがう|違う|間違え)"
#: Nouns of which a number of characters is said, not that they have it.
GENERIC = ("言葉", "名前", "単語", "合言葉", "題名", "漢字", "文章", "手紙", "全部", "本文", "残り")
MENTION = rf"{NUMBER}(?:文字|字|拍)"


def char_counts(word: Column) -> Column:
    """Counts that a claim may mean: letters and numbers, visible characters, all characters, letters without markup."""
    bare = T.plain(word)
    return F.array_distinct(F.array(T.letters(bare), T.visible(bare), F.length(bare), T.letters(word)))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, k, sentence, following: all sentences of a text, speech included."""
    parts = F.filter(F.transform(F.regexp_extract_all(T.normalized(F.col("text")), F.lit(r"[^。！？!?\n]+[。！？!?]*"), F.lit(0)), T.trimmed), lambda s: s != "")
    rows = D.fixed(docs.select("doc_id", "text"), parts=parts)
    return rows.select("doc_id", "parts", F.posexplode("parts").alias("k", "sentence")).select("doc_id", "k", "sentence", F.get("parts", F.col("k") + 1).alias("following"))


def context(sentence: Column, following: Column, before: Column) -> Column:
    """assert, unsure or skip: how a claim is meant.  What stands in an open quote is somebody's."""
    speech = F.regexp_count(before, F.lit("「")) > F.regexp_count(before, F.lit("」"))
    return (
        F.when(sentence.rlike(SKIP) | F.coalesce(following.rlike(TAKEN_BACK), F.lit(False)), "skip")
        .when(sentence.rlike(UNSURE) | speech, "unsure").otherwise("assert")
    )


def count_claims(docs: DataFrame) -> DataFrame:
    """doc_id, k (sentence), rule (C01 characters, C03 morae, C02 without quotes), form, word, said, unit, means, holds, severity.

    A number that is taken back for another counts as the other one.  A word that can't be counted gives no severity; C02 is never more
    than a warning, and generic nouns aren't words that have a number of characters.
    """
    rows = sentences(docs)
    s = F.col("sentence")
    forms = (("corrected", CORRECTED, 1, 2, 3), ("forward", FORWARD, 1, 2, 3), ("reverse", REVERSE, 3, 1, 2), ("bare", BARE, 1, 2, 3))
    part = lambda p, k: F.regexp_extract(s, p, k)

    def found(name, p, word, number, unit):
        return F.when(s.rlike(p), F.struct(F.lit(name).alias("form"), part(p, word).alias("word"), part(p, number).alias("number"), part(p, unit).alias("unit"), F.left(s, F.instr(s, part(p, 0)) - 1).alias("before")))

    corrected, forward, reverse, bare = (found(*f) for f in forms)
    claim = F.filter(F.array(F.coalesce(corrected, forward), reverse, F.when(F.coalesce(corrected, forward, reverse).isNull(), bare)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "k", "sentence", "following", F.explode(claim).alias("c")).filter((F.col("c.form") != "bare") | ~F.col("c.word").isin(*GENERIC))
    rows = D.fixed(rows, said=T.parse_number(F.col("c.number")), means=F.when((F.col("c.form") == "corrected") & ~s.rlike(SKIP), "assert").otherwise(context(s, F.col("following"), F.col("c.before"))))
    word, characters = F.col("c.word"), F.col("c.unit").isin("文字", "字")
    rows = D.fixed(rows, holds=F.when(characters, F.array_contains(char_counts(word), F.col("said"))).otherwise(T.morae(word) == F.col("said")))
    rule = F.when(F.col("c.form") == "bare", "C02").when(characters, "C01").otherwise("C03")
    wrong = ~F.col("holds") & (F.col("means") != "skip")
    severity = F.when(wrong & (F.col("c.form") != "bare") & (F.col("means") == "assert"), "FAIL").when(wrong, "WARN")
    return rows.select("doc_id", "k", rule.alias("rule"), F.col("c.form").alias("form"), word.alias("word"), "said", F.col("c.unit").alias("unit"), "means", "holds", severity.alias("severity"))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, k, hit: numbers of characters or morae in sentences that make no claim of the kinds above."""
    handled = count_claims(docs).select("doc_id", "k").distinct()
    rows = sentences(docs).filter(F.col("sentence").rlike(MENTION)).join(handled, ["doc_id", "k"], "left_anti")
    return rows.select("doc_id", "k", F.explode(F.regexp_extract_all("sentence", F.lit(MENTION), F.lit(0))).alias("hit"))


VERSE_WORDS = "(?:俳句|短歌|一句|川柳)"


def verse(docs: DataFrame) -> DataFrame:
    """doc_id, line, shape, is_verse: lines of kana parts beside a line that speaks of verse, and whether they are 5-7-5 or 5-7-5-7-7, or 17 or 31 in all."""
    w = Window.partitionBy("doc_id").orderBy("line")
    spoken = F.col("raw").rlike(VERSE_WORDS)
    lines = D.lines(docs).withColumn("beside", F.coalesce(F.lag(spoken).over(w), F.lit(False)) | F.coalesce(F.lead(spoken).over(w), F.lit(False)))
    parts = F.filter(F.split(T.trimmed(F.col("raw")), "[ \\x{3000}]+"), lambda x: x != "")
    rows = D.fixed(lines.filter("beside"), parts=parts).filter(F.size("parts") >= 3)
    rows = D.fixed(rows, morae=F.transform("parts", T.morae)).filter(~F.exists("morae", lambda m: m.isNull()))
    total = F.aggregate("morae", F.lit(0), lambda a, m: a + m)
    shape = F.array_join(F.transform("morae", lambda m: m.cast("string")), "-")
    return rows.select("doc_id", "line", shape.alias("shape"), (shape.isin("5-7-5", "5-7-5-7-7") | total.isin(17, 31)).alias("is_verse"))


DATE = r"(?:([0-9０-９]{4})年)?([0-9０-９]{1,2})月([0-9０-９]{1,2})日(?:（([月火水木金土日])）)?"


def date_claims(docs: DataFrame) -> DataFrame:
    """doc_id, said, valid, weekday_fits: dates of years 1600 to 2400 with an optional weekday; without a year any day that some year has is valid."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(DATE), F.lit(0))).alias("said"))
    part = lambda k: F.translate(F.regexp_extract("said", DATE, k), "０１２３４５６７８９", "0123456789")
    year = F.when(part(1) == "", "2000").otherwise(part(1))  # a leap year stands for all
    date = F.try_to_date(F.concat(year, F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
    day = F.substring(F.lit(WEEKDAYS), F.weekday("date") + 1, F.lit(1))
    rows = D.fixed(found, date=date, weekday=F.when(part(1) != "", F.nullif(F.regexp_extract("said", DATE, 4), F.lit(""))), year=year.cast("int")).filter("year BETWEEN 1600 AND 2400")
    return rows.select("doc_id", "said", F.col("date").isNotNull().alias("valid"), (day == F.col("weekday")).alias("weekday_fits"))


def near(docs: DataFrame, left: str, right: str, within: int = 60) -> DataFrame:
    """doc_id, pos of ``left`` matches with a ``right`` match at most ``within`` characters away.

    Matches are put in cells of that width, so a document's matches meet only those of the same and the neighbouring cells.
    """
    hits = lambda p: docs.filter(F.col("text").rlike(p)).select("doc_id", F.explode(T.offsets(F.col("text"), p)).alias("x")).select("doc_id", F.col("x.pos").alias("pos"))
    a = hits(left).withColumn("cell", F.floor(F.col("pos") / within))
    b = hits(right).withColumn("at", F.floor(F.col("pos") / within)).select("doc_id", F.col("pos").alias("other"), F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("cell"))
    joined = a.join(b, ["doc_id", "cell"]).filter(F.abs(F.col("pos") - F.col("other")) <= within)
    return joined.select("doc_id", "pos").distinct()


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """First and last n non-empty lines of each document, with edge = first, last or both."""
    up, down = Window.partitionBy("doc_id").orderBy("line"), Window.partitionBy("doc_id").orderBy(F.desc("line"))
    ranked = lines.filter(T.trimmed(F.col("raw")) != "").withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)})
    return ranked.filter((F.col("a") <= n) | (F.col("b") <= n)).withColumn("edge", F.when((F.col("a") <= n) & (F.col("b") <= n), "both").when(F.col("a") <= n, "first").otherwise("last")).drop("a", "b")
