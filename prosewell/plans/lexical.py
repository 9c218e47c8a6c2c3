"""Queries over words and marks: densities, shares, notation, claims, edges and glossaries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import JAPANESE, LATIN
from prosewell.operators import claims as C
from prosewell.operators import decompose as D
from prosewell.plans.base import MANUSCRIPT_SQL, base, documents, inline, manuscripts, query, quoted, s_count, s_has, s_kind, s_plain, s_searched, s_sub, s_trim, s_visible, table, values

_LATIN = base()


# ------------------------------------------------------------------ claims
_KANJI_DIGITS = "一二三四五六七八九"


def s_number(t: str) -> str:
    """``parse_number``: hundreds, tens and ones by what stands before and after their signs."""
    ascii_ = f"translate({t}, '０１２３４５６７８９', '0123456789')"
    digit = lambda x: f"strpos('{_KANJI_DIGITS}', {x})"
    place = lambda sign, before: f"CASE WHEN contains({t}, '{sign}') THEN greatest(1, CASE WHEN {before} = '' THEN 0 ELSE {digit(before)} END) * {100 if sign == '百' else 10} ELSE 0 END"
    one = f"regexp_extract({t}, '([{_KANJI_DIGITS}])$', 1)"
    folded = f"({place('百', f'regexp_extract({t}, {quoted(chr(94) + "([" + _KANJI_DIGITS + "]?)百")}, 1)')} + {place('十', f'regexp_extract({t}, {quoted("([" + _KANJI_DIGITS + "]?)十")}, 1)')} + CASE WHEN {one} = '' THEN 0 ELSE {digit(one)} END)"
    return f"""CASE WHEN {t} = 'ひと' THEN 1 WHEN {t} = 'ふた' THEN 2 WHEN regexp_full_match({ascii_}, '[0-9]{{1,9}}') THEN {ascii_}::INT
WHEN regexp_full_match({t}, '[〇{_KANJI_DIGITS}]{{1,9}}') THEN translate({t}, '〇{_KANJI_DIGITS}', '0123456789')::INT WHEN regexp_full_match({t}, '[〇{_KANJI_DIGITS}十百]+') THEN ({folded})::INT END"""


def s_morae(word: str) -> str:
    core = s_sub(word, r"[^\p{L}\p{N}ー]")
    return f"CASE WHEN regexp_full_match({core}, '[{T.KANA}]+') THEN length({s_sub(core, '[ゃゅょぁぃぅぇぉゎャュョァィゥェォヮ]')}) END"


def s_counts(word: str) -> str:
    letters = lambda x: f"length({s_sub(x, r'[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')})"
    bare = s_plain(word)
    return f"list_distinct([{letters(bare)}, {s_visible(bare)}, length({bare}), {letters(word)}])"


_SENTENCE = f"""WITH cut AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {quoted('[^。！？!?' + chr(92) + 'n]+[。！？!?]*')}), lambda x: {s_trim('x')}), lambda x: x <> '') AS p FROM {MANUSCRIPT_SQL}),
sentence AS (SELECT doc_id, unnest(range(0, len(p)))::INT AS k, unnest(p) AS s, unnest(list_append(p[2:], NULL)) AS following FROM cut)"""


def _form(name: str, pattern: str, word: int, number: int, unit: int) -> str:
    part = lambda k: f"regexp_extract(s, {quoted(pattern)}, {k})"
    return f"SELECT doc_id, k, s, following, '{name}' AS form, {part(word)} AS word, {part(number)} AS number, {part(unit)} AS unit, left(s, strpos(s, {part(0)}) - 1) AS before FROM sentence WHERE {s_has('s', pattern)}"


_CLAIMED = f"""{_SENTENCE}, corrected AS ({_form('corrected', C.CORRECTED, 1, 2, 3)}), forward AS ({_form('forward', C.FORWARD, 1, 2, 3)}), reverse AS ({_form('reverse', C.REVERSE, 3, 1, 2)}), bare AS ({_form('bare', C.BARE, 1, 2, 3)}),
quotes AS (SELECT * FROM corrected UNION ALL SELECT * FROM forward f WHERE NOT EXISTS (SELECT 1 FROM corrected c WHERE c.doc_id = f.doc_id AND c.k = f.k) UNION ALL SELECT * FROM reverse),
claim AS (SELECT * FROM quotes UNION ALL SELECT * FROM bare b WHERE word NOT IN ({', '.join(map(quoted, C.GENERIC))}) AND NOT EXISTS (SELECT 1 FROM quotes q WHERE q.doc_id = b.doc_id AND q.k = b.k)),
judged AS (SELECT *, {s_number('number')} AS said, CASE WHEN form = 'corrected' AND NOT {s_has('s', C.SKIP)} THEN 'assert' WHEN {s_has('s', C.SKIP)} OR coalesce({s_has('following', C.TAKEN_BACK)}, false) THEN 'skip'
  WHEN {s_has('s', C.UNSURE)} OR len(regexp_extract_all(before, '「')) > len(regexp_extract_all(before, '」')) THEN 'unsure' ELSE 'assert' END AS means FROM claim),
held AS (SELECT *, CASE WHEN unit IN ('文字', '字') THEN list_contains({s_counts('word')}, said) ELSE {s_morae('word')} = said END AS holds FROM judged)"""


@query("count_claims", f"""{_CLAIMED} SELECT doc_id, k, CASE WHEN form = 'bare' THEN 'C02' WHEN unit IN ('文字', '字') THEN 'C01' ELSE 'C03' END AS rule, form, word, said, unit, means, holds,
CASE WHEN NOT holds AND means <> 'skip' THEN CASE WHEN form <> 'bare' AND means = 'assert' THEN 'FAIL' ELSE 'WARN' END END AS severity FROM held""")
def _(spark, d):
    return C.count_claims(manuscripts(spark, d))


@query("number_parse", f"SELECT doc_id, s, {s_number('s')} AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted('[0-9０-９〇一二三四五六七八九十百]+|ひと|ふた')})) AS s FROM {MANUSCRIPT_SQL})")
def _(spark, d):
    words = F.explode(F.regexp_extract_all("text", F.lit("[0-9０-９〇一二三四五六七八九十百]+|ひと|ふた"), F.lit(0))).alias("s")
    return manuscripts(spark, d).select("doc_id", words).withColumn("n", T.parse_number(F.col("s")))


@query("word_counts", f"SELECT doc_id, word, {s_morae('word')} AS morae, list_sort({s_counts('word')}) AS counts FROM (SELECT doc_id, unnest(regexp_extract_all(text, '「([^「」]+)」', 1)) AS word FROM {MANUSCRIPT_SQL})")
def _(spark, d):
    words = F.explode(F.regexp_extract_all("text", F.lit("「([^「」]+)」"), F.lit(1))).alias("word")
    return manuscripts(spark, d).select("doc_id", words).select("doc_id", "word", T.morae(F.col("word")).alias("morae"), F.sort_array(C.char_counts(F.col("word"))).alias("counts"))


@query("c07_mentions", f"{_CLAIMED} SELECT doc_id, k, unnest(regexp_extract_all(s, {quoted(C.MENTION)})) AS hit FROM sentence t WHERE {s_has('s', C.MENTION)} AND NOT EXISTS (SELECT 1 FROM claim c WHERE c.doc_id = t.doc_id AND c.k = t.k)")
def _(spark, d):
    return C.mentions(manuscripts(spark, d))


_JA = base(MANUSCRIPT_SQL, JAPANESE)


@query("c04_verse", f"""{_JA}, v AS (SELECT *, coalesce(lag({s_has('raw', C.VERSE_WORDS)}) OVER w, false) OR coalesce(lead({s_has('raw', C.VERSE_WORDS)}) OVER w, false) AS beside FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
p AS (SELECT doc_id, line, list_filter(string_split_regex({s_trim('raw')}, {quoted('[ ' + chr(0x3000) + ']+')}), lambda x: x <> '') AS parts FROM v WHERE beside), m AS (SELECT doc_id, line, list_transform(parts, lambda x: {s_morae('x')}) AS morae FROM p WHERE len(parts) >= 3)
SELECT doc_id, line, array_to_string(morae, '-') AS shape, array_to_string(morae, '-') IN ('5-7-5', '5-7-5-7-7') OR list_sum(morae) IN (17, 31) AS is_verse FROM m WHERE len(list_filter(morae, lambda x: x IS NULL)) = 0""")
def _(spark, d):
    return C.verse(manuscripts(spark, d))


_MENTIONS = {"C05": JAPANESE.cues["asks"], "C06": "(?:三つ|四つ|五つ|ひとつ)"}


@query("c05_c06_mentions", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule, unnest(regexp_extract_all(text, {quoted(p)})) AS hit FROM {MANUSCRIPT_SQL}" for k, p in _MENTIONS.items()))
def _(spark, d):
    def named(rule: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda h: F.struct(F.lit(rule).alias("rule"), h.alias("hit")))

    rows = F.explode(F.concat(*(named(k, p) for k, p in _MENTIONS.items())))
    return manuscripts(spark, d).select("doc_id", rows.alias("r")).select("doc_id", "r.*")


_PART = lambda k: f"translate(regexp_extract(said, {quoted(C.DATE)}, {k}), '０１２３４５６７８９', '0123456789')"


@query("c08_dates", f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(C.DATE)})) AS said FROM {MANUSCRIPT_SQL}), y AS (SELECT *, CASE WHEN {_PART(1)} = '' THEN '2000' ELSE {_PART(1)} END AS year FROM f),
t AS (SELECT *, try_cast(year || '-' || lpad({_PART(2)}, 2, '0') || '-' || lpad({_PART(3)}, 2, '0') AS DATE) AS date, CASE WHEN {_PART(1)} <> '' THEN nullif(regexp_extract(said, {quoted(C.DATE)}, 4), '') END AS day FROM y WHERE year::INT BETWEEN 1600 AND 2400)
SELECT doc_id, said, date IS NOT NULL AS valid, substr('{C.WEEKDAYS}', isodow(date)::INT, 1) = day AS weekday_fits FROM t""")
def _(spark, d):
    return C.date_claims(manuscripts(spark, d))


def _hits(p: str) -> str:
    return f"""(SELECT doc_id, length(array_to_string(g[1:k], '')) + length(array_to_string(h[1:k - 1], '')) AS pos FROM (SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS k FROM (
SELECT doc_id, string_split_regex(text, {quoted(p)}) AS g, regexp_extract_all(text, {quoted(p)}) AS h FROM documents WHERE {s_has('text', p)})))"""


@query("c09_band", f"SELECT DISTINCT a.doc_id, a.pos::INT AS pos FROM {_hits('[0-9]+')} a JOIN {_hits('[@$]')} b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 60")
def _(spark, d):
    return C.near(documents(spark, d), "[0-9]+", "[@$]")


# ------------------------------------------------------------------ whole text, edges, glossary
@query("m01_empty", f"SELECT doc_id, n, CASE WHEN n = 0 THEN 'FAIL' ELSE 'WARN' END AS severity FROM (SELECT doc_id, {s_visible('text')} AS n FROM documents) WHERE n < 100")
def _(spark, d):
    n = documents(spark, d).select("doc_id", T.visible(F.col("text")).alias("n")).filter("n < 100")
    return n.select("doc_id", "n", F.when(F.col("n") == 0, "FAIL").otherwise("WARN").alias("severity"))


_META = "(?i)(?:license|rights reserved|http)"


@query("m02_edges", f"""{_LATIN}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line DESC) AS b FROM line WHERE {s_trim('raw')} <> '')
SELECT doc_id, line, CASE WHEN a <= 5 AND b <= 5 THEN 'both' WHEN a <= 5 THEN 'first' ELSE 'last' END AS edge FROM r WHERE (a <= 5 OR b <= 5) AND {s_has('raw', _META)}""")
def _(spark, d):
    return C.first_lines(D.lines(documents(spark, d)), 5).filter(F.col("raw").rlike(_META)).select("doc_id", "line", "edge")


@query("x01_leak", f"{_LATIN} SELECT doc_id, line, {s_count('body', '(?i)token|api|key')} AS hits FROM body WHERE {s_has('body', '(?i)token|api|key')}")
def _(spark, d):
    return D.body_lines(documents(spark, d)).withColumn("hits", F.regexp_count("body", F.lit("(?i)token|api|key"))).filter("hits > 0").select("doc_id", "line", "hits")


_FORBIDDEN = (("idiot",), ("moron",), ("clown",), ("worthless",))


@query("g01_forbidden", f"{_LATIN} SELECT doc_id, line, word FROM body, {values(_FORBIDDEN, 'word')} WHERE contains(body, word)")
def _(spark, d):
    words = F.filter(F.array(*(F.lit(w) for (w,) in _FORBIDDEN)), lambda w: F.contains(F.col("body"), w))
    return D.body_lines(documents(spark, d)).select("doc_id", "line", F.explode(words).alias("word"))


_VARIANTS = (("THE", "the"), ("Und", "und"), ("Les", "les"))


@query("g02_variants", f"{_LATIN} SELECT doc_id, line, variant, canonical FROM body, {values(_VARIANTS, 'variant, canonical')} WHERE contains(body, variant)")
def _(spark, d):
    known = F.array(*(F.struct(F.lit(a).alias("variant"), F.lit(b).alias("canonical")) for a, b in _VARIANTS))
    return D.body_lines(documents(spark, d)).select("doc_id", "line", F.explode(F.filter(known, lambda v: F.contains(F.col("body"), v["variant"]))).alias("v")).select("doc_id", "line", "v.*")


@query("o01_opening", f"""{_LATIN}, c AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY line) - chars AS before FROM body)
SELECT doc_id, min(line) AS line FROM c WHERE before < 200 AND {s_has(s_searched('body', LATIN), LATIN.heads)} GROUP BY doc_id""")
def _(spark, d):
    before = F.sum("chars").over(Window.partitionBy("doc_id").orderBy("line")) - F.col("chars")
    return D.body_lines(documents(spark, d)).withColumn("before", before).filter(F.col("before") < 200).filter(T.searched(F.col("body"), LATIN).rlike(LATIN.heads)).groupBy("doc_id").agg(F.min("line").alias("line"))


@query("o02_ending", f"""{_LATIN} SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line DESC) AS k FROM body) WHERE k <= 2 AND {s_has(s_searched('body', LATIN), LATIN.heads)}""")
def _(spark, d):
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("line")))
    return D.body_lines(documents(spark, d)).withColumn("k", last).filter("k <= 2").filter(T.searched(F.col("body"), LATIN).rlike(LATIN.heads)).select("doc_id", "line")


_COMMENT = r"(?s)<!--.*?-->"


@query("strip_html_comments", f"SELECT page_id, length({s_sub(s_sub('html', _COMMENT), '(?s)<[^>]*>')}) AS n FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(F.regexp_replace(F.regexp_replace("html", _COMMENT, ""), "(?s)<[^>]*>", "")).alias("n"))
