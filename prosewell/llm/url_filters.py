"""URL filters: rules indexed by their rarest literal token, candidates fetched by URL tokens, regular expressions on those only.

Built-in functions throughout.  A rule is (action, host, path): it fits the host and its subdomains when the URL's path starts
with the rule's path, in which ``*`` stands for any run of characters.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosewell.llm.scratch import free_name, quoted

#: Up to this many rules travel inside the plan as a literal map; more are joined, and Spark chooses the join by size.
PLAN_RULES = 256


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_regex(host: str, path: str) -> str:
    """Pattern over host + path.  A host holds no slash, so the path can only begin where the host ends."""
    return r"(?s)^(?:[^/]*\.)?" + re.escape(host) + ".*".join(re.escape(piece) for piece in path.split("*"))


def rule_tokens(host: str, path: str) -> list[str]:
    """Tokens that every URL fitting the rule has whole: host labels, and path segments that the rule closes with a slash."""
    closed = path.split("/")[1:-1]
    return [f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in closed if "*" not in x]


def url_tokens(host: Column, path: Column) -> Column:
    tagged = lambda tag, parts: F.transform(parts, lambda x: F.concat(F.lit(tag), x))
    return F.array_distinct(F.concat(tagged("h:", F.split(host, r"\.")), tagged("p:", F.split(path, "/"))))


def rarest_tokens(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> list[str]:
    """For each rule the token that the fewest URLs of the whole table have; ties go to the smaller token."""
    wanted = sorted({t for _, host, path in rules for t in rule_tokens(host, path)})
    tokens = pages.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    if len(wanted) <= 4 * PLAN_RULES:
        seen = tokens.filter(F.col("token").isin(wanted)).groupBy("token").count()
    else:  # counted first: a token that most URLs have must not meet the names row by row
        seen = tokens.groupBy("token").count().join(pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    count = {r["token"]: r["count"] for r in seen.collect()}  # one row for each token of the rules at most
    return [min(rule_tokens(host, path), key=lambda t: (count.get(t, 0), t)) for _, host, path in rules]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", plan_rules: int = PLAN_RULES) -> DataFrame:
    """Every row of ``pages`` (column ``url``) with host, path, rule and verdict.

    The longest fitting rule wins (of equal ones a block, then the smaller rule text); without one, rule is null and verdict
    ``default``.  Null URLs and text without ``://`` have an empty host and path and fit no rule.  Repeated rows are judged each;
    an input column named like an output is replaced; an empty table gives an empty one.
    """
    host, path = split_url(F.col("url"))
    kept = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict"}]
    judged = pages.select(*map(quoted, kept), host.alias("host"), path.alias("path"))
    if not rules:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    index = [
        (token, len(host + path), int(action == "block"), [-ord(c) for c in host + path], host + path, action, rule_regex(host, path))
        for token, (action, host, path) in zip(rarest_tokens(judged, rules), rules, strict=True)
    ]
    schema = "token string, len int, blocks int, ties array<int>, rule string, action string, regex string"
    best = _best_in_plan if len(rules) <= plan_rules else _best_by_join
    out = best(judged, pages.sparkSession.createDataFrame(index, schema), index, schema, name := free_name("best", judged.columns))
    return out.select(*map(quoted, kept), "host", "path", F.col(f"{name}.rule").alias("rule"), F.coalesce(f"{name}.action", F.lit(default)).alias("verdict"))


def _fits(rule: Column) -> Column:
    return F.rlike(F.concat("host", "path"), rule["regex"])


def _best_in_plan(judged: DataFrame, _table: DataFrame, index: list[tuple], schema: str, name: str) -> DataFrame:
    kind = f"array<struct<{', '.join(':'.join(x.split(' ')) for x in schema.split(', ')[1:])}>>"
    by_token: dict[str, list[Column]] = {}
    for token, size, blocks, ties, rule, action, regex in index:
        fields = (F.lit(size).alias("len"), F.lit(blocks).alias("blocks"), F.array(*map(F.lit, ties)).alias("ties"), F.lit(rule).alias("rule"), F.lit(action).alias("action"), F.lit(regex).alias("regex"))
        by_token.setdefault(token, []).append(F.struct(*fields))
    table = F.create_map(*(x for token, rules in by_token.items() for x in (F.lit(token), F.array(*rules))))
    fetched = F.flatten(F.transform(url_tokens(F.col("host"), F.col("path")), lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast(kind))))
    return judged.withColumn(name, F.array_max(F.filter(fetched, _fits)))


def _best_by_join(judged: DataFrame, table: DataFrame, _index: list[tuple], _schema: str, name: str) -> DataFrame:
    """Distinct URLs only are joined; the best rule is a maximum, so it is combined before the shuffle."""
    urls = judged.select("host", "path").distinct()
    fetched = urls.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(table, "token")
    fitting = fetched.withColumn(name, F.struct("len", "blocks", "ties", "rule", "action", "regex")).filter(_fits(F.col(name)))
    return judged.join(fitting.groupBy("host", "path").agg(F.max(name).alias(name)), ["host", "path"], "left")


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

SQL = """
WITH rules(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (SELECT p.*, (SELECT max(struct_pack(len := length(r.host || r.path), rule := r.host || r.path, action := r.action)) FROM rules r
  WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM judged
"""


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")
