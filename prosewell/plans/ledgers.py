"""Queries over ledgers that are drawn from the tables: threads, facts, decisions, stored judgements, prompts, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosewell.functions.profile import JAPANESE
from prosewell.operators import evaluation as E
from prosewell.operators import ledger as L
from prosewell.operators import lint
from prosewell.operators import rules as R
from prosewell.operators import stats as S
from prosewell.plans.base import MANUSCRIPT_SQL, base, manuscripts, query, quoted, table
from prosewell.plans.lint import lint_sql
from prosewell.plans.prose import stats_sql


@query("maintained_threads", """SELECT o_orderkey AS id, status, last FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'planted' WHEN 'P' THEN 'reminded' ELSE 'paid' END AS status FROM orders) o
LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey WHERE status IN ('planted', 'reminded') AND NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey = o_orderkey AND h.l_returnflag = 'R')""")
def _(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "planted").when(F.col("o_orderstatus") == "P", "reminded").otherwise("paid").alias("status"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_returnflag")
    return L.maintained(items, lines.filter("l_returnflag = 'R'"), lines, "id", "l_linenumber", ["planted", "reminded"])


_FACTS = """(SELECT l_orderkey || '-' || l_linenumber AS id, l_linenumber AS ch, CASE l_returnflag WHEN 'N' THEN 'proposed' ELSE 'fixed' END AS status, [l_suppkey % 9, l_partkey % 9] AS chars,
CASE WHEN l_linestatus = 'F' AND l_linenumber > 1 THEN l_orderkey || '-' || (l_linenumber - 1) END AS supersedes FROM lineitem)"""


@query("facts_in_play", f"""WITH f AS (SELECT * FROM {_FACTS} WHERE ch < 6) SELECT id, ch, status FROM f WHERE (list_has_any(chars, [1, 3]) OR ch >= 4 OR status = 'proposed') AND NOT EXISTS (SELECT 1 FROM f g WHERE g.supersedes = f.id)""")
def _(spark, d):
    key = lambda n: F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), n.cast("string"))
    line = F.col("l_linenumber")
    facts = table(spark, d, "lineitem").select(
        key(line).alias("id"), line.alias("ch"), F.when(F.col("l_returnflag") == "N", "proposed").otherwise("fixed").alias("status"), F.array(F.col("l_suppkey") % 9, F.col("l_partkey") % 9).alias("chars"),
        F.when((F.col("l_linestatus") == "F") & (line > 1), key(line - 1)).alias("supersedes"),
    )
    return L.relevant_facts(facts, [1, 3], 6).select("id", "ch", "status")


@query("decisions_for", """WITH e AS (SELECT event_id AS id, event_type AS kind, epoch_us(ts) AS date, [user_id % 9, user_id % 4] AS affects FROM events)
SELECT id, kind FROM e WHERE list_contains(affects, 7) UNION SELECT id, kind FROM (SELECT id, kind FROM e ORDER BY date DESC, id DESC LIMIT 5)""")
def _(spark, d):
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("date"), F.array(F.col("user_id") % 9, F.col("user_id") % 4).alias("affects"))
    return L.decisions_for(events, [7]).select("id", "kind")


_NEEDS = {"en": 130, "fr": 10_000, "de": 1, "it": 1}


@query("required_material", f"SELECT name, coalesce(n, 0) AS filled, needed::INT AS needed FROM (VALUES {', '.join(f'({quoted(k)}, {v})' for k, v in _NEEDS.items())}) w(name, needed) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON lang = name WHERE coalesce(n, 0) < needed")
def _(spark, d):
    filled = table(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("filled"))
    return L.lacking(filled, _NEEDS)


_K = R.Lines(only=("K", "S"))
_OLD = {r: R.LEVELS[r]["default"] for r in R.DENSITY if "default" in R.LEVELS[r]}
_MANUAL = {"K07": {"info": 9.0}}


@query("calibrate_densities", f"""WITH f AS (SELECT rule, value FROM ({lint_sql(MANUSCRIPT_SQL, JAPANESE, _K)}) WHERE rule IN ({', '.join(map(quoted, _OLD))}) AND rule <> 'K08' AND severity <> 'STRONG'),
g AS (SELECT rule, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, CASE rule {' '.join(f"WHEN {quoted(k)} THEN {0.5 * (i or w or 1)}" for k, (i, w, _) in _OLD.items())} END AS floor FROM f GROUP BY rule HAVING count(*) >= 3)
SELECT rule, n, CASE WHEN rule = 'K07' THEN 9.0 ELSE round(greatest(m + sd, 1.15 * m, floor), 3) END::DOUBLE AS info, round(greatest(m + 2 * sd, 1.3 * m, 1.5 * floor), 3)::DOUBLE AS warn FROM g""")
def _(spark, d):
    found = lint.lint(manuscripts(spark, d), JAPANESE, _K).filter(F.col("rule").isin(*_OLD) & (F.col("severity") != "STRONG"))
    return E.density_lines(found, "rule", "value", _OLD, _MANUAL, off=("K08",))


@query("calibrate_dialogue", f"{base(MANUSCRIPT_SQL, JAPANESE)}{stats_sql(MANUSCRIPT_SQL, JAPANESE)} SELECT round(avg(dialogue_ratio), 3) AS target, round(greatest(0.1, 2 * stddev_pop(dialogue_ratio)), 3) AS tolerance FROM fig WHERE chars >= 500 HAVING count(dialogue_ratio) >= 3")
def _(spark, d):
    return E.dialogue_target(S.doc_stats(manuscripts(spark, d), JAPANESE).filter("chars >= 500"), "dialogue_ratio")


@query("lint_record", f"""SELECT doc_id, {', '.join(f"nullif(count(*) FILTER (severity = '{s}'), 0) AS {s}_diagnostics, sum(hits) FILTER (severity = '{s}')::BIGINT AS {s}_locations, CASE WHEN count(*) FILTER (severity = '{s}') > 0 THEN list_sort(list_distinct(list(rule) FILTER (severity = '{s}'))) END AS {s}_rules" for s in R.SEVERITIES)}
FROM ({lint_sql(MANUSCRIPT_SQL, JAPANESE, R.Lines(only=('R', 'L', 'P', 'M')))}) GROUP BY doc_id""")
def _(spark, d):
    found = E.pivoted(lint.lint(manuscripts(spark, d), JAPANESE, R.Lines(only=("R", "L", "P", "M"))))
    # without rows of a severity there is nothing, not none
    return found.select("doc_id", *(c for s in R.SEVERITIES for c in (F.nullif(f"{s}_diagnostics", F.lit(0)).alias(f"{s}_diagnostics"), F.col(f"{s}_locations"), F.when(F.size(f"{s}_rules") > 0, F.col(f"{s}_rules")).alias(f"{s}_rules"))))


_JUDGED = "doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0"


@query("stored_judgments", f"SELECT doc_id, CASE WHEN {_JUDGED} AND quality = 1 THEN 'A' END AS preference FROM labels")
def _(spark, d):
    key = F.col("doc_id")
    record = {
        "ok": key % 5 != 0, "preference": F.when(F.col("quality") == 1, "A").otherwise("B"), "request_sha": F.sha2(key.cast("string"), 256), "request_now": F.sha2(F.when(key % 7 == 0, F.lit("edited")).otherwise(key.cast("string")), 256),
        "judge": F.lit("judge"), "judge_now": F.when(key % 11 == 0, "other").otherwise("judge"), "verdict_sha": F.lit("v"), "verdict_now": F.lit("v"), "verdict_text": F.lit("text\nPREFERENCE: A"),
    }
    return table(spark, d, "labels").select("doc_id", E.judgment(record).alias("preference"))


@query("tree_hashes", "SELECT source AS tree, left(sha256(string_agg(doc_id::VARCHAR || chr(0) || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id::VARCHAR)), 16) AS hash FROM documents GROUP BY source")
def _(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("tree"), F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return E.tree_hash(files, "tree", "path", "sha")


_PROMPTS = "(SELECT item_id::VARCHAR AS name, CASE WHEN item_id % 3 > 0 THEN (item_id % 9)::VARCHAR END AS base, text FROM benchmark)"


@query("load_prompts", f"SELECT p.name, CASE WHEN b.text IS NULL THEN p.text ELSE b.text || chr(10) || p.text END AS text FROM {_PROMPTS} p LEFT JOIN (SELECT * FROM {_PROMPTS} WHERE name::INT < 6) b ON b.name = p.base WHERE p.base IS NULL OR b.name IS NOT NULL")
def _(spark, d):
    prompts = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.when(F.col("item_id") % 3 > 0, (F.col("item_id") % 9).cast("string")).alias("base"), "text")
    return E.load_prompts(prompts, prompts.filter(F.col("name").cast("int") < 6))[0]


@query("missing_prompts", f"SELECT name, base AS missing FROM {_PROMPTS} WHERE base IS NOT NULL AND base::INT >= 6")
def _(spark, d):
    prompts = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.when(F.col("item_id") % 3 > 0, (F.col("item_id") % 9).cast("string")).alias("base"), "text")
    return E.load_prompts(prompts, prompts.filter(F.col("name").cast("int") < 6))[1]


@query("log_audit", f"SELECT page_id AS key, page_id % 3 = 0 AS missing, CASE WHEN page_id % 3 = 0 THEN 0 ELSE len(regexp_extract_all(html, {quoted('(?i)(?:track|token|login)')})) END::INT AS hits FROM pages")
def _(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("text"))
    return E.audited(pages.select("key"), pages.filter("key % 3 <> 0"), "(?i)(?:track|token|login)")
