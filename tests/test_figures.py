"""Roundings and records of findings, on planted rows."""

import duckdb
from pyspark.sql import functions as F

from prosewell.operators import evaluation as E
from prosewell.operators.stats import rounded


def test_rounding_is_that_of_the_sql(spark):
    shares = [(k, n) for n in (40, 80, 200, 2000) for k in range(n)]
    got = spark.createDataFrame(shares, "k long, n long").select("k", "n", *(rounded(F.col("k") / F.col("n"), d).alias(f"r{d}") for d in (1, 2, 3)), rounded(-F.col("k") / F.col("n"), 2).alias("down"))
    con = duckdb.connect()
    for n in (40, 80, 200, 2000):
        want = con.sql(f"SELECT k, round(k / {n}, 1), round(k / {n}, 2), round(k / {n}, 3), round(-k / {n}, 2) FROM range({n}) t(k) ORDER BY k").fetchall()
        assert [(r["k"], r["r1"], r["r2"], r["r3"], r["down"]) for r in got.filter(F.col("n") == n).orderBy("k").collect()] == want


def test_record_of_findings(spark):
    rows = [(1, "N01", "FAIL", 2), (1, "N03", "FAIL", 1), (1, "N01", "FAIL", 4), (1, "K01", "INFO", None), (2, "R01", "WARN", 3)]
    got = {r["doc_id"]: r for r in E.pivoted(spark.createDataFrame(rows, "doc_id long, rule string, severity string, hits long")).collect()}
    assert (got[1]["FAIL_diagnostics"], got[1]["FAIL_locations"], got[1]["FAIL_rules"]) == (3, 7, ["N01", "N03"])
    assert (got[1]["INFO_diagnostics"], got[1]["INFO_locations"], got[2]["WARN_diagnostics"]) == (1, None, 1)
    assert not got[2]["FAIL_diagnostics"] and got[2]["FAIL_locations"] is None
