"""Queries over every row of their inputs, by tables of a few rows."""

from datetime import datetime

from vigilake.plans import catalog

ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def orders(spark, path, rows):
    spark.createDataFrame([(k, c, s, float(p), datetime.fromisoformat(d), priority) for k, c, s, p, d, priority in rows], ORDER).write.parquet(f"{path}/orders.parquet")
    return str(path)


def run(spark, sf, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name][0](spark, sf).collect())


def test_failed_scans_are_latest_scans_too(spark, tmp_path):
    sf = orders(spark, tmp_path, [(37, 4, "O", 1, "1996-01-03", "5-LOW"), (2, 4, "O", 1, "1996-01-01", "5-LOW"), (74, 5, "O", 1, "1996-01-02", "5-LOW")])
    got = [r[:4] for r in run(spark, sf, "w1_latest_scans")]
    assert got == [("npm", "pkg-4", 37, "ERROR"), ("pypi", "pkg-5", 74, "ERROR")]
    assert [r[:4] for r in run(spark, sf, "w1_latest_without_error")] == [("npm", "pkg-4", 2, "LOW_RISK")]


def test_every_paid_plan_has_its_value(spark, tmp_path):
    rows = [(1, 4, "F", 1, "2001-01-01", "1-URGENT"), (2, 4, "F", 1, "2001-07-30", "2-HIGH"), (3, 5, "O", 1, "2001-07-02", "3-MEDIUM"), (6, 5, "O", 1, "2001-07-22", "3-MEDIUM"), (7, 5, "O", 1, "2001-07-02", "5-LOW")]
    got = run(spark, orders(spark, tmp_path, rows), "a22_lifetime_value")
    assert got == [("enterprise", 49900.0, 1.0, 1663.33, 0.33), ("pro", 2900.0, 20.0, 1933.33, 0.39), ("team", 9900.0, 2.0, 660.0, 0.13)]
    assert run(spark, str(tmp_path), "a22_yearly_value") == [(413.0, 5.5067, 2.5862, 20.0, 2.0)]
