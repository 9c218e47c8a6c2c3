"""Queries over ledgers, packs, evaluations and calibration; the star-schema tables stand for project ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosewell.functions import text as T
from prosewell.operators import decompose as D
from prosewell.operators import evaluation as E
from prosewell.operators import ledger as L
from prosewell.operators import stats as S
from prosewell.plans.base import base, documents, query, quoted, s_visible, table

_LATIN = base()
_TERMS = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS canonical, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS reading FROM customer)"


@query("e02_required", f"SELECT 'E02' AS code, id::VARCHAR AS key, c AS detail FROM (SELECT id, unnest(['canonical', 'reading']) AS c, unnest([canonical, reading]) AS v FROM {_TERMS}) WHERE v IS NULL OR trim(v) = ''")
def _(spark, d):
    key = F.col("c_custkey")
    return L.required(table(spark, d, "customer").select(key.alias("id"), F.when(key % 7 == 0, " ").otherwise(F.col("c_name")).alias("canonical"), F.when(key % 5 > 0, F.col("c_mktsegment")).alias("reading")), "id", ["canonical", "reading"])


@query("e03_domain", "SELECT 'E03' AS code, o_orderkey::VARCHAR AS key, o_orderpriority AS detail FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def _(spark, d):
    return L.outside(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("e04_orphans", "SELECT 'E04' AS code, o_orderkey::VARCHAR AS key, o_custkey::VARCHAR AS detail FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def _(spark, d):
    return L.orphans(table(spark, d, "orders"), "o_orderkey", "o_custkey", table(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey")


_FILES = "(SELECT 'ch' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || CASE WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.md' END AS name, (doc_id % 1000 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END)::INT AS chapter FROM documents)"


@query("e05_misnumbered", f"""SELECT 'E05' AS code, name AS key, chapter::VARCHAR AS detail FROM {_FILES} WHERE try_cast(regexp_extract(name, '^ch([0-9]{{3}})', 1) AS INT) IS DISTINCT FROM chapter
UNION ALL SELECT 'E05', 'chapter ' || chapter, count(*)::VARCHAR FROM {_FILES} GROUP BY chapter HAVING count(*) > 1""")
def _(spark, d):
    n = F.col("doc_id") % 1000
    name = F.concat(F.lit("ch"), F.lpad(n.cast("string"), 3, "0"), F.when(F.col("doc_id") % 11 == 0, ".txt").otherwise(".md"))
    return L.misnumbered(table(spark, d, "documents").select(name.alias("name"), (n + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("int").alias("chapter")), "name", "chapter")


@query("e06_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _(spark, d):
    return L.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("w01_overdue", "SELECT o_orderkey, count(*) AS late FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey")
def _(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.filter("l_shipdate > o_orderdate + INTERVAL 60 DAYS").groupBy("o_orderkey").agg(F.count("*").alias("late"))


@query("w02_stale_touch", "SELECT event_id, user_id, gap FROM (SELECT event_id, user_id, epoch_us(ts) // 1000000 - max(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM events) WHERE gap > 86400")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    return L.last_before(rows, "user_id", "at").filter("gap > 86400").select("event_id", "user_id", "gap")


@query("w03_state", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def _(spark, d):
    open_ = table(spark, d, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").join(open_, "o_orderkey", "left_semi").select("o_orderkey")


@query("w06_lag", "SELECT user_id, count(*) AS stale FROM (SELECT user_id, ts, max(ts) OVER () AS now FROM events WHERE event_type = 'view') WHERE ts < now - INTERVAL 7 DAY GROUP BY user_id")
def _(spark, d):
    views = table(spark, d, "events").filter("event_type = 'view'")
    now = views.agg(F.max("ts").alias("now"))  # one row
    return views.crossJoin(F.broadcast(now)).filter("ts < now - INTERVAL 7 DAYS").groupBy("user_id").agg(F.count("*").alias("stale"))


@query("w08_gaps", "SELECT lang, doc_id FROM (SELECT lang, unnest(range(min(doc_id), max(doc_id) + 1)) AS doc_id FROM documents GROUP BY lang) e WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.lang = e.lang AND c.doc_id = e.doc_id)")
def _(spark, d):
    return L.gaps(table(spark, d, "documents"), "lang", "doc_id")


@query("w10_trailing3", "SELECT user_id, min(event_type) AS value FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3 GROUP BY user_id HAVING count(*) = 3 AND count(DISTINCT event_type) = 1")
def _(spark, d):
    return L.trailing_equal(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 3)


@query("w11_refs", "SELECT DISTINCT l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 45)")
def _(spark, d):
    kept = table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").select("l_partkey").distinct().join(kept, "l_partkey", "left_anti")


@query("i02_same_head", "SELECT upper(left(p_type, 1)) AS head, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return L.same_head(table(spark, d, "part"), "p_partkey", "p_type")


@query("i04_flat3", "SELECT event_id FROM (SELECT event_id, value AS a, lag(value, 1) OVER w AS b, lag(value, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE c IS NOT NULL AND greatest(a, b, c) - least(a, b, c) <= 5 AND greatest(a, b, c) > 0")
def _(spark, d):
    return L.flat(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 5).select("event_id")


# ------------------------------------------------------------------ packs
@query("asof_latest", "SELECT l_partkey AS who, l_suppkey AS whom, l_orderkey AS id, l_linenumber AS from_ch FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber DESC, l_orderkey DESC) AS k FROM lineitem WHERE l_linenumber < 5) WHERE k = 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("who"), F.col("l_suppkey").alias("whom"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("from_ch"))
    return L.latest(rows, ["who", "whom"], "from_ch", "id", F.lit(5))


@query("asof_events", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(spark, d):
    return L.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


_PACK = f"(SELECT source, doc_id AS block, doc_id % 11 AS priority, {s_visible('text')} AS size, doc_id % 11 > 6 AS droppable FROM documents)"


@query("pack_budget", f"""SELECT source, block, priority, size FROM (SELECT *, sum(CASE WHEN droppable THEN 0 ELSE size END) OVER (PARTITION BY source) AS fixed,
sum(CASE WHEN droppable THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY priority, block) AS running FROM {_PACK}) WHERE NOT droppable OR fixed + running <= 100000""")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select("source", F.col("doc_id").alias("block"), (F.col("doc_id") % 11).alias("priority"), T.visible(F.col("text")).alias("size"), (F.col("doc_id") % 11 > 6).alias("droppable"))
    return L.pack(rows, "source", 100_000).select("source", "block", "priority", "size")


@query("source_hash", """SELECT source, sha256(string_agg(sha, chr(10) ORDER BY cell)) AS digest FROM (SELECT source, left(sha256(doc_id::VARCHAR), 2) AS cell, sha256(string_agg(doc_id::VARCHAR || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id::VARCHAR)) AS sha
FROM documents GROUP BY source, left(sha256(doc_id::VARCHAR), 2)) GROUP BY source""")
def _(spark, d):
    return L.source_hash(spark.read.parquet(f"{d}/documents.parquet"), "source", "doc_id", "text")


@query("change_log_asof", """SELECT user_id, event_id FROM (SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_id % 13 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM events) WHERE since IS NULL OR since < 5""")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 13).alias("ch"))
    return L.as_of(rows, "user_id", "event_id", "ch", 5).select("user_id", "event_id")


# ------------------------------------------------------------------ evaluation
@query("pair_assign", "SELECT doc_id, row_number() OVER (PARTITION BY left(h, 1) ORDER BY h) % 2 = 0 AS flipped FROM (SELECT doc_id, sha256('seed' || doc_id::VARCHAR) AS h FROM labels)")
def _(spark, d):
    return E.assign(table(spark, d, "labels").select("doc_id"), "doc_id", "seed")


_JUDGED = "(SELECT doc_id, CASE quality WHEN 1 THEN 'A' WHEN 0 THEN 'B' END AS one, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'tie' WHEN toxic = 1 THEN 'B' ELSE 'A' END AS two FROM labels)"


def _judged(spark, d):
    one = F.when(F.col("quality") == 1, "A").when(F.col("quality") == 0, "B")
    two = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 5 == 0, "tie").when(F.col("toxic") == 1, "B").otherwise("A")
    return table(spark, d, "labels").select("doc_id", one.alias("one"), two.alias("two"))


_SETTLE = "CASE WHEN one IS NULL OR two IS NULL THEN 'failed' WHEN one = 'tie' OR two = 'tie' THEN 'undecidable' WHEN one = two THEN one ELSE 'unstable' END"


@query("settle_pairs", f"SELECT doc_id, {_SETTLE} AS result FROM {_JUDGED}")
def _(spark, d):
    return _judged(spark, d).select("doc_id", E.settle(F.col("one"), F.col("two")).alias("result"))


@query("tally_by_prompt", f"SELECT doc_id % 10 AS prompt, {_SETTLE} AS result, count(*) AS n FROM {_JUDGED} GROUP BY ALL")
def _(spark, d):
    settled = _judged(spark, d).select((F.col("doc_id") % 10).alias("prompt"), E.settle(F.col("one"), F.col("two")).alias("result"))
    return settled.groupBy("prompt", "result").agg(F.count("*").alias("n"))


_VERDICT_TEXT = """CASE doc_id % 6 WHEN 0 THEN 'PREFERENCE: A' || chr(10) || chr(10) WHEN 1 THEN 'PREFERENCE: B' || chr(10) || 'but then' WHEN 2 THEN '```' || chr(10) || 'PREFERENCE: A' WHEN 3 THEN '> PREFERENCE: A' WHEN 4 THEN '```' || chr(10) || 'x' || chr(10) || '```' || chr(10) || 'PREFERENCE: tie' ELSE '' END"""


@query("verdict_parse", f"""SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: starts_with(x, '```'))) % 2 = 0 THEN nullif(regexp_extract(l[-1], '^PREFERENCE: (A|B|tie)\\s*$', 1), '') END AS preference
FROM (SELECT doc_id, list_filter(string_split(coalesce(text, '') || chr(10) || {_VERDICT_TEXT}, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents)""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(_VERDICT_TEXT.replace("chr(10)", "char(10)"))).alias("text"))
    return docs.select("doc_id", E.verdict(F.col("text")).alias("preference"))


_CHANGED = {"response": 3, "prompt": 5, "preamble": 7, "tree": 11}


@query("record_validity", """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN quality = 0 THEN 'not ok' WHEN doc_id % 3 = 0 THEN 'text changed' WHEN doc_id % 5 = 0 THEN 'prompt changed' WHEN doc_id % 7 = 0 THEN 'preamble changed' WHEN toxic = 1 THEN 'other command'
WHEN doc_id % 17 = 0 THEN 'empty' WHEN doc_id % 11 = 0 THEN 'other tree' END AS reason FROM labels""")
def _(spark, d):
    key = F.col("doc_id")
    sha = lambda n: (F.lit("a"), F.when(key % n == 0, "b").otherwise("a"))
    (response, actual), (prompt, prompt_now), (preamble, preamble_now), (tree, tree_now) = (sha(n) for n in _CHANGED.values())
    record = {
        "path": F.when(key % 13 != 0, "p"), "ok": F.col("quality") != 0, "response_sha": response, "actual_sha": actual, "prompt_sha": prompt, "prompt_now": prompt_now, "preamble_sha": preamble, "preamble_now": preamble_now,
        "command": F.lit("g"), "expected_command": F.when(F.col("toxic") == 1, "h").otherwise("g"), "text": F.when(key % 17 == 0, "  ").otherwise("text"), "tree": tree, "tree_now": tree_now,
    }
    return table(spark, d, "labels").select("doc_id", E.validity(record, strict=True).alias("reason"))


@query("text_hashes", r"SELECT item_id, left(sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), 12) AS hash FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", E.text_hash(F.col("text")).alias("hash"))


@query("job_matrix", "SELECT item_id, trial, arm FROM benchmark, (VALUES (1), (2)) t(trial), (VALUES ('old'), ('new')) a(arm) WHERE NOT (item_id % 3 = 0 AND trial = 1)")
def _(spark, d):
    arms = F.explode(F.array(*(F.struct(F.lit(t).alias("trial"), F.lit(a).alias("arm")) for t in (1, 2) for a in ("old", "new"))))
    jobs = table(spark, d, "benchmark").select("item_id", arms.alias("x")).select("item_id", "x.*")
    done = table(spark, d, "benchmark").filter("item_id % 3 = 0").select("item_id", F.lit(1).alias("trial"))
    return jobs.join(done, ["item_id", "trial"], "left_anti").select("item_id", "trial", "arm")


# ------------------------------------------------------------------ calibration
_BLOCK = f"""{_LATIN}, b AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line, idx) - 1) // 20 AS block, chars, cls FROM sent)"""


@query("block20_cv", f"{_BLOCK} SELECT doc_id, block, round(stddev_pop(chars) / avg(chars), 3) AS cv FROM b GROUP BY doc_id, block HAVING count(*) = 20")
def _(spark, d):
    return E.blocks(D.sentences(documents(spark, d)))


@query("ta_block_rate", f"{_BLOCK} SELECT doc_id, block, round(avg(CASE WHEN cls = 'past' THEN 1.0 ELSE 0.0 END), 3) AS rate FROM b GROUP BY doc_id, block HAVING count(*) = 20")
def _(spark, d):
    from pyspark.sql import Window

    s = D.sentences(documents(spark, d)).withColumn("block", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "idx")) - 1) / 20))
    return s.groupBy("doc_id", "block").agg(F.count("*").alias("n"), S.rounded(F.avg(F.when(F.col("cls") == "past", 1.0).otherwise(0.0))).alias("rate")).filter("n = 20").select("doc_id", "block", "rate")


@query("mid_runs", f"{_LATIN}, m AS (SELECT doc_id, line, idx, chars BETWEEN 30 AND 45 AS mid FROM sent), t AS (SELECT *, sum(CASE WHEN lag_mid IS NOT DISTINCT FROM mid THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line, idx) AS run FROM (SELECT *, lag(mid) OVER (PARTITION BY doc_id ORDER BY line, idx) AS lag_mid FROM m)) SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, run, count(*) AS n FROM t WHERE mid GROUP BY doc_id, run) GROUP BY doc_id")
def _(spark, d):
    mid = D.sentences(documents(spark, d)).withColumn("mid", F.col("chars").between(30, 45))
    return D.row_runs(mid, "mid").filter("value").groupBy("doc_id").agg(F.max("length").alias("longest"))


@query("nearest_rank_pct", f"SELECT source, list_sort(list(n))[(floor(0.1 * (count(*) - 1) + 0.5))::INT + 1] AS p10, list_sort(list(n))[(floor(0.5 * (count(*) - 1) + 0.5))::INT + 1] AS p50, list_sort(list(n))[(floor(0.9 * (count(*) - 1) + 0.5))::INT + 1] AS p90 FROM (SELECT source, {s_visible('text')} AS n FROM documents) GROUP BY source")
def _(spark, d):
    n = table(spark, d, "documents").select("source", T.visible(F.col("text")).alias("n"))
    return E.nearest_ranks(n, "source", "n", {f"p{round(100 * q)}": q for q in (0.1, 0.5, 0.9)})


def _lines_sql(lower: bool) -> str:
    sign, (a, b) = ("-", (0.85, 0.7)) if lower else ("+", (1.15, 1.3))
    line = lambda k, f: f"round(greatest(avg(v) {sign} {k} * stddev_pop(v), {f}::DOUBLE * avg(v)), 3)"
    return f"{_LATIN}, f AS (SELECT doc_id, stddev_pop(chars) / avg(chars) AS v FROM sent GROUP BY doc_id HAVING count(*) >= 30) SELECT lang, count(v) AS n, round(avg(v), 3) AS mean, {line(1, a)} AS info, {line(2, b)} AS warn FROM f JOIN documents USING (doc_id) GROUP BY lang HAVING count(v) >= 3"


def _calibrated(name: str, lower: bool):
    @query(name, _lines_sql(lower))
    def _(spark, d):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        figures = D.sentences(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("k"), (F.stddev_pop("chars") / F.avg("chars")).alias("v")).filter("k >= 30")
        return E.alarm_lines(figures.join(docs.select("doc_id", "lang"), "doc_id"), "lang", "v", lower)


_calibrated("calibrate_lower", True)
_calibrated("calibrate_upper", False)
