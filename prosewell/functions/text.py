"""Column functions over text: counts, markup, numbers and kinds of lines.  Built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from prosewell.functions.profile import MARK, Profile

SPACE = r"[\s\x{3000}]"
BLANKS = " \t\n\x0b\f\r\u3000"
#: Unicode ranges, and the notation of emphasis, ruby, scene breaks and document marks.
KANJI = r"々〆ヵヶ㐀-䶿一-鿿豈-﫿"
KANA = r"ぁ-ゖァ-ヺー"
EMPHASIS = r"《《([^《》\n]+)》》"
RUBY = r"[｜|]([^｜|《》\n]+)《([^《》\n]+)》"
BARE_RUBY = f"([{KANJI}])《[{KANA}・]+》"
HEADING = r"^#{1,6}[ \t\x{3000}]+"
SCENE = r"^[＊\s\x{3000}]*＊[＊\s\x{3000}]*$"
SILENT = r"^[…‥！？!?。、―—\s\x{3000}]*[…‥！？!?][…‥！？!?。、―—\s\x{3000}]*$"
SYMBOLS = r"^[\p{P}\p{S}\s\x{3000}]+$"
DOCUMENT_MARK = "＞"
ESCAPES = ("\\＞", "＼＞")

KINDS = ("blank", "heading", "scene", "symbol", "dialogue", "bracket", "narration", "document", "docblank")


def normalized(text: Column) -> Column:
    """Without a byte order mark, lines ending in LF; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\x{FEFF}", ""), r"\r\n?", "\n")


def visible(text: Column) -> Column:
    """Code points that aren't white space, ideographic space included."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def plain(text: Column) -> Column:
    """Without emphasis, ruby and bare ruby, in this order."""
    return F.when(F.contains(text, F.lit("》")), F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMPHASIS, "$1"), RUBY, "$1"), BARE_RUBY, "$1")).otherwise(text)


NOT_WORD = r"[^a-zà-öø-ÿœ]+"


def searched(text: Column, profile: Profile) -> Column:
    """Text as the lexicon patterns of a profile want it: lower case, and if spaced every word with its own blanks."""
    low = F.lower(text)
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(low, f"^{NOT_WORD}", ""), NOT_WORD, "  "), F.lit(" ")) if profile.spaced else low


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def document_body(line: Column) -> Column:
    """A line without its document mark, or without the escape before one."""
    marked = F.startswith(line, F.lit(DOCUMENT_MARK)) | reduce(lambda a, b: a | b, (F.startswith(line, F.lit(e)) for e in ESCAPES))
    return F.when(marked, F.substring(line, 2, 1 << 30)).otherwise(line)


def is_symbols(line: Column) -> Column:
    return line.rlike(SYMBOLS) & ~line.rlike("[「『（]") & ~line.rlike(SILENT)


def line_kind(line: Column, body: Column | None = None, bare: Column | None = None) -> Column:
    """One of KINDS.  What starts with the document mark is document or docblank, whatever it looks like.

    body: the line without that mark, bare: the body trimmed, if they are at hand.
    """
    body = document_body(line) if body is None else body
    bare = trimmed(body) if bare is None else bare
    return (
        F.when(F.startswith(line, F.lit(DOCUMENT_MARK)), F.when(bare == "", "docblank").otherwise("document"))
        .when(bare == "", "blank")
        .when(body.rlike(HEADING), "heading")
        .when(bare.rlike(SCENE), "scene")
        .when(is_symbols(bare), "symbol")
        .when(bare.rlike("^[「『]"), "dialogue")
        .when(bare.rlike("^[（【〈《]") & ~F.startswith(bare, F.lit("《《")), "bracket")
        .otherwise("narration")
    )


def heading_title(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, HEADING, ""), r"[ \t\x{3000}]*#*[ \t\x{3000}]*$", "")


def sentence_end(sentence: Column, profile: Profile) -> Column:
    """The last characters of a sentence, without marks."""
    return F.right(F.regexp_replace(F.lower(sentence), profile.tail, ""), F.lit(profile.reach))


def ending_class(end: Column, profile: Profile) -> Column:
    """The class of the end of a sentence."""
    chain = F.when(end == "", "other")
    for name, pattern in profile.endings:
        chain = chain.when(end.rlike(pattern), name)
    return chain.otherwise("other")


def marked(body: Column, profile: Profile) -> Column:
    """A line with MARK in place of each utterance; lines without quotes are as they are."""
    out = F.regexp_replace(body, profile.utterance, MARK)
    for pattern, stays in profile.framed:
        out = F.regexp_replace(out, pattern, stays.replace("{1}", "$1"))
    return F.when(body.rlike(profile.quotes), out).otherwise(body)


def marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit("")))


def excerpt(text: Column, n: int = 24) -> Column:
    """One line of at most n characters, what was cut shown by an ellipsis."""
    flat = trimmed(F.regexp_replace(text, r"\n+", " "))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def has_letters(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def offsets(text: Column, pattern: str) -> Column:
    """Array of {pos, hit}: where (from 0) a pattern matches, by the lengths of what lies between."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,hit:string>>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["gap"]) + F.length(x["hit"])).cast("int").alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["gap"])).cast("int").alias("pos"), x["hit"].alias("hit")))).alias("out"))
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    return F.aggregate(zipped, start, step)["out"]


_DIGITS = "〇一二三四五六七八九"


def parse_number(text: Column) -> Column:
    """ASCII, full-width and kanji numbers up to 999, positional zeros and two words; null for anything else."""
    bare = trimmed(text)
    ascii_ = F.translate(bare, "０１２３４５６７８９", "0123456789")
    digit = lambda c: F.instr(F.lit(_DIGITS), c) - 1
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"))

    def step(s, c):
        unit = F.when(c == "百", 100).when(c == "十", 10)
        value = F.when(s["now"] == 0, 1).otherwise(s["now"])
        return F.struct(F.when(unit.isNotNull(), s["total"] + value * unit).otherwise(s["total"]).alias("total"), F.when(unit.isNotNull(), 0).otherwise(digit(c)).alias("now"))

    folded = F.aggregate(F.split(bare, ""), state, step, lambda s: s["total"] + s["now"])
    return (
        F.when(bare == "ひと", 1)
        .when(bare == "ふた", 2)
        .when(ascii_.rlike("^[0-9]{1,9}$"), ascii_.try_cast("int"))
        .when(bare.rlike(f"^[{_DIGITS}]{{1,9}}$"), F.translate(bare, _DIGITS, "0123456789").try_cast("int"))
        .when(bare.rlike(f"^[{_DIGITS}十百]+$"), folded)
    )


def morae(word: Column) -> Column:
    """Morae of a kana word; small kana belong to the one before; null if any other letter or number is in it."""
    core = F.regexp_replace(word, r"[^\p{L}\p{N}ー]", "")
    return F.when(core.rlike(f"^[{KANA}]+$"), F.length(F.regexp_replace(core, "[ゃゅょぁぃぅぇぉゎャュョァィゥェォヮ]", "")))


def quotes_balanced(line: Column) -> Column:
    """Whether both kinds of quotes nest properly: a stack of openers as text."""
    step = lambda s, c: (
        F.when(s == "x", s)
        .when(c.isin("「", "『"), F.concat(s, c))
        .when(c == "」", F.when(s.endswith("「"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise("x"))
        .when(c == "』", F.when(s.endswith("『"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise("x"))
        .otherwise(s)
    )
    return F.aggregate(F.regexp_extract_all(line, F.lit("[「」『』]"), F.lit(0)), F.lit(""), step) == ""
