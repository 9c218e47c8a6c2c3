"""Queries over prose: decomposition, statistics, rhythm, paragraphs, dialogue and windows.

Those ending in _ja run over the manuscripts that ``base`` puts together, one for each document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prosewell.functions import text as T
from prosewell.functions.profile import JAPANESE, LATIN, Profile
from prosewell.operators import decompose as D
from prosewell.operators import rules as R
from prosewell.operators import stats as S
from prosewell.plans.base import MANUSCRIPT_SQL, base, documents, manuscripts, query, quoted, s_has, s_runs, table

_LATIN, _JA = base(), base(MANUSCRIPT_SQL, JAPANESE)
_SOURCES = {"": (_LATIN, LATIN, documents), "_ja": (_JA, JAPANESE, manuscripts)}


def both(name: str, sql: str, rows) -> None:
    """Registers a query over the documents, and over the manuscripts as name_ja; sql follows ``base``, rows(docs, profile) are the query's."""
    for suffix, (start, profile, source) in _SOURCES.items():

        @query(name + suffix, f"{start}{sql(profile) if callable(sql) else sql}")
        def _(spark, d, profile=profile, source=source):
            return rows(source(spark, d), profile)


both("lines", " SELECT doc_id, line, raw FROM line", lambda docs, p: D.lines(docs))
both("line_kinds", " SELECT doc_id, line, kind FROM kind", lambda docs, p: D.kinds(docs).select("doc_id", "line", "kind"))
both("body_lines", " SELECT doc_id, line, kind, body, chars FROM body", lambda docs, p: D.body_lines(docs))
both("paragraph_kinds", " SELECT doc_id, line, kind, chars, narr_chars, utterances, n_sent FROM para", lambda docs, p: D.paragraphs(docs, p).drop("body", "narr"))
both("sentences", " SELECT doc_id, line, idx, sentence, chars, commas FROM sent", lambda docs, p: D.sentences(docs, p).select("doc_id", "line", "idx", "sentence", "chars", "commas"))
both("sentence_endings", " SELECT doc_id, line, idx, cls FROM sent", lambda docs, p: D.sentences(docs, p).select("doc_id", "line", "idx", "cls"))
both("speech_tags", " SELECT doc_id, line, idx, sentence FROM asent WHERE tag", lambda docs, p: D.all_sentences(docs, p).filter("tag").select("doc_id", "line", "idx", "sentence"))
both("silent_lines", " SELECT doc_id, line, chars FROM paras WHERE kind = 'silent'", lambda docs, p: D.document(docs, p).select("doc_id", F.explode(F.filter("paras", lambda x: x["kind"] == "silent")).alias("p")).select("doc_id", "p.line", "p.chars"))
both("search_scopes", " SELECT doc_id, line, narr, body FROM para WHERE narr_chars > 0", lambda docs, p: D.paragraphs(docs, p).filter("narr_chars > 0").select("doc_id", "line", "narr", "body"))
both("excerpts", " SELECT doc_id, line, CASE WHEN length(t) > 24 THEN left(t, 24) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, line, " + "regexp_replace(body, '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g') AS t FROM body)", lambda docs, p: D.body_lines(docs).select("doc_id", "line", T.excerpt(F.col("body")).alias("excerpt")))
both(
    "utterances", lambda p: f" SELECT doc_id, line, unnest(range(0, len(u))) AS idx, unnest(u) AS utterance FROM (SELECT doc_id, line, regexp_extract_all(body, {quoted(p.utterance)}) AS u FROM body)",
    lambda docs, p: D.utterances(docs, p).select("doc_id", "line", "idx", "utterance"),
)
both("quote_balance", lambda p: f""" SELECT doc_id, line, s = '' AS balanced FROM (SELECT doc_id, line, list_reduce(list_prepend('', regexp_extract_all(body, '[「」『』]')), lambda s, c: CASE WHEN s = 'x' THEN s
WHEN c IN ('「', '『') THEN s || c WHEN (c = '」' AND ends_with(s, '「')) OR (c = '』' AND ends_with(s, '『')) THEN left(s, length(s) - 1) ELSE 'x' END) AS s FROM body)""", lambda docs, p: D.body_lines(docs).select("doc_id", "line", T.quotes_balanced(F.col("body")).alias("balanced")))

_OFF = f"""SELECT doc_id, (length(array_to_string(g[1:k], '')) + length(array_to_string(h[1:k - 1], '')))::INT AS pos, h[k] AS hit FROM (
SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS k FROM (SELECT doc_id, string_split_regex(text, {quoted('[0-9]+')}) AS g, regexp_extract_all(text, {quoted('[0-9]+')}) AS h FROM documents))"""


@query("find_all_offsets", _OFF)
def _(spark, d):
    hits = documents(spark, d).filter(F.col("text").rlike("[0-9]")).select("doc_id", F.explode(T.offsets(F.col("text"), "[0-9]+")).alias("x"))
    return hits.select("doc_id", "x.pos", "x.hit")


def stats_sql(source: str, profile: Profile) -> str:
    """CTEs run, fig (a row of figures a document) after ``base``."""
    polite = f"coalesce(round(avg(CASE WHEN cls = '{profile.polite}' THEN 1.0 ELSE 0.0 END), 3) >= 0.5, false)" if profile.polite else "false"
    return f""", run AS (SELECT * FROM {s_runs('tok', 'value')} WHERE value <> 'D'),
p AS (SELECT doc_id, sum(chars) AS chars, sum(narr_chars) AS narration_chars, sum(CASE WHEN utterances > 0 THEN chars - narr_chars - 2 * utterances ELSE 0 END) AS spoken, sum(utterances) AS utterances, count(*) FILTER (kind = 'narration') AS narration_paragraphs,
  avg(chars) FILTER (kind = 'narration') AS pm, CASE WHEN count(*) FILTER (kind = 'narration') >= 2 THEN stddev_pop(chars) FILTER (kind = 'narration') END AS ps, sum({f"len(regexp_extract_all(body, '[一-龥々〆]'))"}) AS kanji FROM paras GROUP BY doc_id),
o AS (SELECT doc_id, avg(CASE WHEN n_sent <= 1 THEN 1.0 ELSE 0.0 END) AS rate FROM para WHERE kind = 'narration' GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS sentences, avg(chars) AS m, median(chars)::DOUBLE AS md, CASE WHEN count(*) >= 2 THEN stddev_pop(chars) END AS sd, max(chars) AS mx, count(*) FILTER (chars <= 10) AS le10, count(*) FILTER (chars >= 80) AS ge80, avg(commas) AS commas,
  round(avg(CASE WHEN cls = '{profile.past}' THEN 1.0 ELSE 0.0 END), 3) AS ta_rate, {polite} AS keitai, count(*) FILTER (cls = '{profile.noun}') AS nouns FROM sent GROUP BY doc_id),
r AS (SELECT doc_id, max(length) FILTER (value <> 'other') AS max_run, sum(length) FILTER (value <> 'other' AND length >= 4) AS in_runs FROM run GROUP BY doc_id),
fig AS (SELECT d.doc_id, coalesce(p.chars, 0)::BIGINT AS chars, coalesce(narration_chars, 0)::BIGINT AS narration_chars, round(spoken / nullif(p.chars, 0), 3) AS dialogue_ratio, coalesce(sentences, 0) AS sentences, round(m, 1) AS sentence_len_mean,
  md AS sentence_len_median, round(sd / nullif(m, 0), 3) AS sentence_len_cv, mx AS sentence_len_max, coalesce(le10, 0) AS sentences_le10, coalesce(ge80, 0) AS sentences_ge80, round(commas, 2) AS commas_per_sentence, ta_rate, coalesce(keitai, false) AS keitai,
  coalesce(max_run, 0) AS same_ending_max_run, round(CASE WHEN sentences > 0 THEN coalesce(in_runs, 0) / sentences END, 3) AS same_ending_run_share, coalesce(narration_paragraphs, 0) AS narration_paragraphs, round(pm, 1) AS paragraph_len_mean,
  round(ps / nullif(pm, 0), 3) AS paragraph_len_cv, round(o.rate, 3) AS one_sentence_paragraph_rate, coalesce(utterances, 0)::BIGINT AS utterances, round(kanji / nullif(p.chars, 0), 3) AS kanji_ratio, coalesce(nouns, 0) AS nouns
  FROM {source} d LEFT JOIN p USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id))"""


_FIG = {LATIN.name: stats_sql("documents", LATIN), JAPANESE.name: stats_sql(MANUSCRIPT_SQL, JAPANESE)}
both("doc_stats", lambda p: f"{_FIG[p.name]} SELECT * EXCLUDE (nouns) FROM fig", S.doc_stats)
both("ending_share", " SELECT doc_id, cls, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 3) AS share FROM sent GROUP BY doc_id, cls", S.ending_share)
both("same_ending_runs", lambda p: f"{_FIG[p.name]} SELECT doc_id, run::BIGINT AS run, value, length, first FROM run", D.runs)
both("dialogue_ratio", lambda p: f"{_FIG[p.name]} SELECT doc_id, dialogue_ratio FROM fig", lambda docs, p: S.doc_stats(docs, p).select("doc_id", "dialogue_ratio"))
both(
    "paragraph_stats", lambda p: f"{_FIG[p.name]} SELECT doc_id, narration_paragraphs, paragraph_len_mean, paragraph_len_cv, one_sentence_paragraph_rate FROM fig",
    lambda docs, p: S.doc_stats(docs, p).select("doc_id", "narration_paragraphs", "paragraph_len_mean", "paragraph_len_cv", "one_sentence_paragraph_rate"),
)
both("kanji_ratio", lambda p: f"{_FIG[p.name]} SELECT doc_id, kanji_ratio FROM fig", lambda docs, p: S.doc_stats(docs, p).select("doc_id", "kanji_ratio"))

# ------------------------------------------------------------------ windows over a table's rows
_TURNS = "(SELECT conv_id AS doc_id, turn AS line, role, text FROM conversations)"


@query("role_runs", f"SELECT doc_id, value AS role, length, first FROM {s_runs(_TURNS, 'role', 'line')}")
def _(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), "role")
    return D.row_runs(turns, "role", ("line",)).select("doc_id", F.col("value").alias("role"), "length", "first")


both("l04_uniform5", """, w AS (SELECT doc_id, row_number() OVER o AS rn, line, min(chars) OVER f AS lo, max(chars) OVER f AS hi, avg(chars) OVER f AS m, count(*) OVER f AS k FROM sent
  WINDOW o AS (PARTITION BY doc_id ORDER BY line, idx), f AS (PARTITION BY doc_id ORDER BY line, idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
h AS (SELECT doc_id, list(rn ORDER BY rn) AS hits FROM w WHERE k = 5 AND lo >= m * 0.75 AND hi <= m * 1.25 GROUP BY doc_id)
SELECT doc_id, list_reduce(list_prepend(struct_pack(last := -5::BIGINT, n := 0::BIGINT), list_transform(hits, lambda x: struct_pack(last := x, n := 0::BIGINT))), lambda s, x: CASE WHEN x.last >= s.last + 5 THEN struct_pack(last := x.last, n := s.n + 1) ELSE s END).n AS hits, (hits[1] - 1)::INT AS first FROM h""", S.uniform_stretches)


@query("repeat_in_window", f"""WITH hit AS (SELECT doc_id, w, (length(array_to_string(g[1:k], '')) + length(array_to_string(h[1:k - 1], ''))) AS pos FROM (
  SELECT doc_id, g, h, lower(h[k]) AS w, k FROM (SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS k FROM (SELECT doc_id, string_split_regex(text, {quoted('[A-Za-z]{9,}')}) AS g, regexp_extract_all(text, {quoted('[A-Za-z]{9,}')}) AS h FROM documents)))),
gap AS (SELECT *, pos - lag(pos, 2) OVER (PARTITION BY doc_id, w ORDER BY pos) AS span FROM hit)
SELECT doc_id, w AS word, min(pos)::INT AS pos FROM gap WHERE span <= 2000 GROUP BY doc_id, w""")
def _(spark, d):
    return S.repeats_in_window(documents(spark, d), "[A-Za-z]{9,}", limit=3, window=2000)


@query("l03_long", f"{_LATIN} SELECT doc_id, line, idx, chars FROM sent WHERE chars > {R.LEVELS['L03']['entertainment'][0]}")
def _(spark, d):
    return D.sentences(documents(spark, d)).filter(F.col("chars") > R.LEVELS["L03"]["entertainment"][0]).select("doc_id", "line", "idx", "chars")


@query("p01_long", f"{_LATIN} SELECT doc_id, line, chars, CASE WHEN chars > 300 THEN 'WARN' ELSE 'INFO' END AS severity FROM para WHERE kind = 'narration' AND chars > 200")
def _(spark, d):
    info, warn, _ = R.LEVELS["P01"]["web"]
    return D.paragraphs(documents(spark, d)).filter((F.col("kind") == "narration") & (F.col("chars") > info)).select("doc_id", "line", "chars", F.when(F.col("chars") > warn, "WARN").otherwise("INFO").alias("severity"))


@query("k17_commas", f"{_LATIN} SELECT doc_id, line, idx, commas FROM sent WHERE commas >= 4")
def _(spark, d):
    return D.sentences(documents(spark, d)).filter(F.col("commas") >= R.LEVELS["K17"]["default"][0]).select("doc_id", "line", "idx", "commas")


def _measures(p: Profile) -> str:
    per = ", ".join(f"round(count(*) FILTER (length >= {k}) * 10000 / any_value(nullif(narration_chars, 0)), 1) AS runs{k}" for k in S.RUN_LENGTHS)
    under = ", ".join(f"round(count(*) FILTER (cv < {line}) / count(*), 3) AS under{round(100 * line)}" for line in S.CV_LINES)
    return f"""{_FIG[p.name]}, per AS (SELECT f.doc_id, {per} FROM fig f LEFT JOIN (SELECT * FROM run WHERE value NOT IN ('other', '{p.noun}')) r USING (doc_id) GROUP BY f.doc_id),
b AS (SELECT doc_id, round(stddev_pop(chars) / nullif(avg(chars), 0), 3) AS cv FROM (SELECT doc_id, chars, (row_number() OVER (PARTITION BY doc_id ORDER BY line, idx) - 1) // 20 AS block FROM sent) GROUP BY doc_id, block HAVING count(*) = 20), bs AS (SELECT doc_id, count(*) AS blocks, {under} FROM b GROUP BY doc_id),
q AS (SELECT doc_id, round(stddev_pop(chars) / nullif(avg(chars), 0), 9) AS cv FROM (SELECT doc_id, chars, (row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1) // 10 AS block FROM paras WHERE kind = 'narration') GROUP BY doc_id, block HAVING count(*) = 10), qs AS (SELECT doc_id, count(*) AS para_blocks, round(sum(cv) / count(*), 3) AS para_cv FROM q GROUP BY doc_id),
u AS (SELECT doc_id, length(regexp_replace(unnest(regexp_extract_all(body, {quoted(p.utterance)})), {quoted(T.SPACE)}, '', 'g')) - 2 AS n FROM paras), us AS (SELECT doc_id, round(count(*) FILTER (n <= {S.SHORT_SAID}) / count(*), 3) AS short_said, round(count(*) FILTER (n >= {S.LONG_SAID}) / count(*), 3) AS long_said FROM u GROUP BY doc_id),
x AS (SELECT doc_id, sum(len(regexp_extract_all(body, {quoted(S.SPLIT)})))::BIGINT AS split FROM paras GROUP BY doc_id)
SELECT per.*, coalesce(blocks, 0) AS blocks, bs.* EXCLUDE (doc_id, blocks), coalesce(para_blocks, 0) AS para_blocks, para_cv, short_said, long_said, coalesce(split, 0) AS split FROM per LEFT JOIN bs USING (doc_id) LEFT JOIN qs USING (doc_id) LEFT JOIN us USING (doc_id) LEFT JOIN x USING (doc_id)"""


both("measures", _measures, S.measures)
