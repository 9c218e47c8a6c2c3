"""Queries over context-dependent structure; small fixtures with the results worked out by hand, tables where there are any."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosewell.operators import decompose as D
from prosewell.operators import ledger as L
from prosewell.operators import structure as S
from prosewell.functions import text as T
from prosewell.functions.profile import JAPANESE
from prosewell.plans.base import MANUSCRIPT_SQL, base, documents, inline, manuscripts, query, quoted, s_has, s_trim, table, values

_LATIN = base()
_JA = base(MANUSCRIPT_SQL, JAPANESE)


def _offsets(rows: str, text: str, pattern: str) -> str:
    """Rows with k, pos and hit of each match."""
    return f"""(SELECT * EXCLUDE (g, h), length(array_to_string(g[1:k + 1], '')) + length(array_to_string(h[1:k], '')) AS pos, h[k + 1] AS hit FROM (SELECT *, unnest(range(0, len(h))) AS k FROM (
SELECT *, string_split_regex({text}, {quoted(pattern)}) AS g, regexp_extract_all({text}, {quoted(pattern)}) AS h FROM {rows})))"""


@query("utterance_spans", f"{_JA} SELECT doc_id, line, pos::INT AS start, (pos + length(hit))::INT AS \"end\" FROM {_offsets('body', 'body', JAPANESE.utterance)}")
def _(spark, d):
    return S.utterance_spans(manuscripts(spark, d))


_CUE = f"({JAPANESE.cues['names']}|{JAPANESE.cues['brings']})"
_BEFORE, _AFTER = s_trim("left(body, pos)"), s_trim("substr(body, pos + length(hit) + 1)")


@query("quote_roles", f"""{_JA}, c AS (SELECT *, coalesce(last_value(CASE WHEN NOT {s_has('body', S.WHOLE)} THEN {s_has(s_trim('body'), _CUE)} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS carried FROM body WHERE kind <> 'document'),
q AS (SELECT *, {_BEFORE} AS before, {_AFTER} AS after FROM {_offsets('c', 'body', S.QUOTES)}),
r AS (SELECT *, CASE WHEN {s_has('before', JAPANESE.cues['names'])} OR (before = '' AND carried) THEN 'other' WHEN {s_has('after', JAPANESE.cues['says'])} AND ({s_has('before', S.HEAD)} OR {s_has('before', S.SUBJECT)}) THEN 'speech'
  WHEN starts_with(hit, '「') AND {s_has('before', S.HEAD)} AND after = '' THEN 'speech' WHEN starts_with(hit, '「') AND {s_has('before', S.HEAD)} AND starts_with(after, '「') THEN NULL ELSE 'other' END AS own FROM q)
SELECT doc_id, line, pos::INT AS start, coalesce(first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, line ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'other') AS role FROM r""")
def _(spark, d):
    return S.quote_roles(manuscripts(spark, d))


_LOOSE = f"""{_JA}, l AS (SELECT *, NOT {s_has('raw', r'^[\x{3000}「『（(【〈《]')} AS loose, max(CASE WHEN starts_with(raw, chr(12288)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS indents FROM kind WHERE kind NOT IN ('blank', 'heading', 'scene', 'symbol', 'docblank', 'document'))"""


@query("document_blocks", f"""{_LOOSE}, t AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT *, lag(raw) OVER (PARTITION BY doc_id ORDER BY line) AS intro, CASE WHEN lag(loose) OVER (PARTITION BY doc_id ORDER BY line) IS NOT DISTINCT FROM loose THEN 0 ELSE 1 END AS turn FROM l WHERE indents = 1))
SELECT doc_id, min(line) AS first, max(line) AS last FROM t WHERE loose GROUP BY doc_id, run HAVING arg_min(coalesce(intro, chr(0)), line) <> chr(0) AND (count(*) >= 2 OR {s_has('arg_min(intro, line)', JAPANESE.cues['brings'])})""")
def _(spark, d):
    return S.document_blocks(manuscripts(spark, d))


_FITS = ", ".join(f"coalesce(lead(line, {k}) OVER o = line + {k} AND lead(kind, {k}) OVER o <> 'document' AND NOT lead({s_has('raw', chr(94) + r'[\s\x{3000}「『]')}, {k}) OVER o, false) AS f{k}" for k in (1, 2, 3))


_FLAT = base(f"(SELECT doc_id, replace(text, chr(12288), '') AS text FROM {MANUSCRIPT_SQL})", JAPANESE)


@query("guessed_blocks", f"""{_FLAT}, g AS (SELECT *, max(CASE WHEN starts_with(raw, chr(12288)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS indents FROM kind WHERE kind NOT IN ('blank', 'heading', 'scene', 'symbol', 'docblank')),
f AS (SELECT *, {_FITS} FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY line)) SELECT doc_id, line, (CASE WHEN f1 THEN 1 + CASE WHEN f2 THEN 1 + CASE WHEN f3 THEN 1 ELSE 0 END ELSE 0 END ELSE 0 END)::BIGINT AS lines FROM f WHERE indents = 0 AND kind <> 'document' AND f1 AND {s_has(s_trim('raw'), JAPANESE.cues['brings'])}""")
def _(spark, d):
    return S.guessed_blocks(manuscripts(spark, d).select("doc_id", F.replace("text", F.lit("\u3000"), F.lit("")).alias("text")))


_DIGITS = quoted("[0-9]+")


@query("sentence_prefixes", f"SELECT doc_id, pos::INT AS pos, regexp_extract(left(text, pos), {quoted(r'[^。！？!?' + chr(92) + r'n]*$')}) AS prefix, len(regexp_extract_all(regexp_extract(left(text, pos), {quoted('[^' + chr(92) + 'n]*$')}), '[「『]')) > len(regexp_extract_all(regexp_extract(left(text, pos), {quoted('[^' + chr(92) + 'n]*$')}), '[」』]')) AS in_quote FROM {_offsets(MANUSCRIPT_SQL, 'text', '彼|夜')}")
def _(spark, d):
    hits = manuscripts(spark, d).select("doc_id", "text", F.explode(T.offsets(F.col("text"), "彼|夜")).alias("x"))
    return hits.select("doc_id", F.col("x.pos").alias("pos"), S.sentence_prefix(F.col("text"), F.col("x.pos")).alias("prefix"), S.in_open_quote(F.col("text"), F.col("x.pos")).alias("in_quote"))


@query("d03_reported", f"""{_LATIN}, p AS (SELECT doc_id, (sum(chars) OVER (PARTITION BY doc_id ORDER BY line, idx) - chars)::BIGINT AS pos FROM sent),
w AS (SELECT doc_id, pos, count(*) OVER f AS n, min(pos) OVER f AS start FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)),
g AS (SELECT doc_id, list_sort(list(DISTINCT struct_pack(pos := pos, start := start))) AS l FROM w WHERE n >= 8 GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(list_prepend(struct_pack("last" := -1::BIGINT, "out" := []::BIGINT[], pos := 0::BIGINT, start := 0::BIGINT), list_transform(l, lambda x: struct_pack("last" := 0::BIGINT, "out" := []::BIGINT[], pos := x.pos, start := x.start))),
  lambda s, x: CASE WHEN x.start > s."last" THEN struct_pack("last" := x.pos, "out" := list_append(s."out", x.start), pos := 0::BIGINT, start := 0::BIGINT) ELSE s END)."out" AS a FROM g)
SELECT doc_id, unnest(a) AS at FROM r""")
def _(spark, d):
    pos = D.sentences(documents(spark, d)).withColumn("pos", F.sum("chars").over(D.in_order()) - F.col("chars")).select("doc_id", "pos")
    return S.crowded_windows(pos, 300, 8)


_NOTES = ((1, "# 文体\n- 人称: 一人称\n- 時制:\n<!-- 注 -->\n- 短い文\n| 語 | 読み |\n|---|---|\n| 駅 | えき |\n| | |\n-"), (2, ""), (3, "key: value\n## 見出し\n\n自由文"))


@query("filled_items", f"SELECT * FROM {values(((1, 3), (2, 0), (3, 2)), 'id, filled')}")
def _(spark, d):
    return S.filled_items(inline(spark, _NOTES, "id long, text string"))


_NOTE = "'# x' || chr(10) || CASE WHEN doc_id % 3 > 0 THEN '## premise' || chr(10) || left(coalesce(text, ''), 60) || '<!-- hidden -->' || chr(10) || 'two moons.' || chr(10) ELSE '' END || '## land' || chr(10) || 'an island.'"


@query("world_section", f"SELECT doc_id, {s_trim(f"split_part(split_part(regexp_replace(n, {quoted('(?s)<!--.*?-->')}, '', 'g'), '## premise' || chr(10), 2), '## land', 1)")} AS premise FROM (SELECT doc_id, {_NOTE} AS n FROM documents)")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.expr(_NOTE.replace("chr(10)", "char(10)")).alias("n")).select("doc_id", S.section(F.col("n"), "premise").alias("premise"))


@query("last_result_event", """SELECT user_id AS id, arg_max(event_id::VARCHAR, event_id) FILTER (event_type = 'purchase') AS result, count(*) FILTER (event_type = 'click') AS tools FROM events GROUP BY user_id""")
def _(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "click", "tool_use").otherwise("other")
    logs = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 9 == 4, F.when(F.col("event_type").isin("purchase", "click"), F.to_json(F.struct(kind.alias("type"), F.col("event_id").cast("string").alias("result")))).otherwise("noise")).otherwise(F.to_json(F.struct(kind.alias("type"), F.col("event_id").cast("string").alias("result")))).alias("raw"))
    return S.last_events(logs)


_CAST = "(SELECT o_orderkey AS id, [o_custkey % 5, o_custkey % 3] AS chapter, [o_orderkey % 5, o_custkey % 7] AS scene FROM orders)"


def _casts(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, d, "orders").select(o.alias("id"), F.array(c % 5, c % 3).alias("chapter"), F.array(o % 5, c % 7).alias("scene"))


@query("w07_scene_cast", f"SELECT id, extra FROM (SELECT id, list_sort(list_distinct(list_filter(scene, lambda x: NOT list_contains(chapter, x)))) AS extra FROM {_CAST}) WHERE len(extra) > 0")
def _(spark, d):
    return _casts(spark, d).select("id", F.sort_array(F.array_except("scene", "chapter")).alias("extra")).filter(F.size("extra") > 0)


@query("cast_union", f"SELECT id, list_distinct(list_concat(chapter, scene)).list_sort() AS members FROM {_CAST}")
def _(spark, d):
    return _casts(spark, d).select("id", F.array_sort(F.array_distinct(F.concat("chapter", "scene"))).alias("members"))


@query("w04_missing_notes", "SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n < 2 THEN 'short' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n IS NULL OR n < 2")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") < 2, "short")
    return table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", state.alias("state")).filter("state IS NOT NULL")


@query("w05_undecided", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '(?:00$|未定|仮)')")
def _(spark, d):
    return table(spark, d, "customer").filter(F.col("c_name").rlike("(?:00$|未定|仮)")).select("c_custkey", "c_name")


@query("w09_no_reason", "SELECT id, rule FROM (SELECT c_custkey AS id, c_mktsegment AS rule, CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 5 > 0 THEN c_name END AS reason FROM customer) WHERE reason IS NULL OR trim(reason) = ''")
def _(spark, d):
    key = F.col("c_custkey")
    return L.without_reason(table(spark, d, "customer").select(key.alias("id"), F.col("c_mktsegment").alias("rule"), F.when(key % 3 == 0, " ").when(key % 5 > 0, F.col("c_name")).alias("reason")), "reason").select("id", "rule")


@query("i01_remaining", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus <> 'F'").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("i03_long_status", f"{_LATIN} SELECT doc_id, count(*) AS n FROM line GROUP BY doc_id HAVING count(*) > 40")
def _(spark, d):
    return D.lines(documents(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 40")


@query("i05_unlogged", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("missing_chapters", "SELECT source, doc_id FROM (SELECT source, unnest(range(min(doc_id), max(doc_id) + 1)) AS doc_id FROM documents GROUP BY source) e WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.source = e.source AND c.doc_id = e.doc_id)")
def _(spark, d):
    return L.gaps(table(spark, d, "documents"), "source", "doc_id")


@query("tail_excerpt", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN position(chr(10) IN right(text, 200)) > 0 THEN substr(right(text, 200), position(chr(10) IN right(text, 200)) + 1) ELSE right(text, 200) END AS tail FROM documents")
def _(spark, d):
    end = F.right("text", F.lit(200))
    cut = F.when(F.length("text") <= 200, F.col("text")).when(F.instr(end, "\n") > 0, F.substring(end, F.instr(end, "\n") + 1, F.lit(200))).otherwise(end)
    return documents(spark, d).select("doc_id", cut.alias("tail"))


@query("summaries_recent", "SELECT source, doc_id, CASE WHEN k <= 3 THEN text ELSE regexp_extract(text, '^[^.!?]*[.!?]*') END AS summary FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents)")
def _(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    rows = spark.read.parquet(f"{d}/documents.parquet").withColumn("k", k)
    return rows.select("source", "doc_id", F.when(F.col("k") <= 3, F.col("text")).otherwise(F.regexp_extract("text", r"^[^.!?]*[.!?]*", 0)).alias("summary"))
