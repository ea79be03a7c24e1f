"""What the third review found: one small test for each finding that was mended."""

import duckdb
from pyspark.sql import functions as F

from sigspark.functions import ranks as k
from sigspark.functions import scalar as s
from sigspark.plans import panel as pn
from sigspark.queries import ORACLE_SQL, QUERIES

from oracle import difference


def test_logarithms_of_zero_are_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, v AS value FROM (VALUES (1, 0.0::DOUBLE), (2, -0.0::DOUBLE), (3, 2.5::DOUBLE), (4, NULL)) t(i, v)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert difference(QUERIES["p13_scalar_functions"](spark, str(tmp_path)), con, ORACLE_SQL["p13_scalar_functions"]) is None
    assert spark.range(1).select(s.logarithm(F.lit(-1.0), F.log1p, -1.0)).first()[0] == float("-inf")


def test_ranked_controls_meet_once_by_date(spark):
    rows = [(i, "2024-01-02" if i % 2 else "2024-01-03", v) for i, v in enumerate([1.0, 1.0, None, -0.0, 0.0, float("nan"), float("nan"), 5.0, 0.0, None, 7.0, 2.0])]
    values = spark.createDataFrame(rows, "permno long, date string, v double").select("permno", "date", *(F.col("v").alias(f"char_{i}") for i in range(3)))
    out = pn.ranked_controls(values)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = values.select("permno", k.centered_feature(["date"], "char_1").alias("x"), F.col("char_1").isNull().cast("int").alias("m")).collect()
    assert sorted(map(tuple, out.select("permno", "char_1", "missing__char_1").collect())) == sorted(map(tuple, want))


def test_grid_of_own_spans_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Against the join it stands for, with dates off the calendar, and in as many tasks as its rows need."""
    cal = spark.createDataFrame([(f"2024-01-{d:02d}", i) for i, d in enumerate((2, 3, 4, 5, 8, 9, 10))], "date string, code int")
    days = [(1, "2024-01-03", 1.0), (1, "2024-01-08", 2.0), (2, "2024-01-01", 3.0), (2, "2024-01-06", 4.0), (2, "2024-01-07", 5.0), (2, "2024-01-09", 6.0), (2, "2024-01-12", 7.0), (3, "2024-01-05", 8.0), (4, "2024-01-06", 9.0), (None, "2024-01-03", 10.0), (None, "2024-01-05", 11.0), (5, None, 12.0)]
    market = spark.createDataFrame(days, "permno long, date string, ret double")
    monkeypatch.setattr(pn, "ROWS_A_TASK", 4)
    out = pn.own_spans(market, cal)
    spans = market.groupBy("permno").agg(F.min("date").alias("low"), F.max("date").alias("high"))
    want = spans.join(cal, F.col("date").between(F.col("low"), F.col("high"))).select("permno", "date", "code").join(market, ["permno", "date"], "left")
    key = lambda r: tuple(map(str, r))
    columns = ["permno", "date", "code", "ret"]
    assert sorted(map(tuple, out.select(*columns).collect()), key=key) == sorted(map(tuple, want.select(*columns).collect()), key=key)
    assert out.rdd.getNumPartitions() >= 12


def test_ranks_of_all_columns_are_the_windows_in_one_exchange(spark):
    rows = [(i, f"2024-01-0{1 + i % 3}", None if i % 7 == 0 else i % 5, [None, float("nan"), -0.0, 0.0, 1.5, 2.5][i % 6], None if i % 11 == 0 else 1.0 if i % 3 == 1 else float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "permno long, date string, a long, b double, y double")
    out = k.with_ranks(df, "date", {"a": "a", "x_b": "b"}, {"q": "y"})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    by = ["date"]
    want = df.select("permno", "date", k.centered_feature(by, "a").alias("a"), k.centered_feature(by, "b").alias("x_b"), k.centered_target(by, "y").alias("q"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.select(*want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert out.where("q is not null").select("date").distinct().count() == 2  # one date has a constant target


def test_exact_quantiles_without_a_group_in_one_task(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", None if i % 7 == 0 else (i * 37 % 101) / 4 - 9) for i in range(200)] + [("empty", None), ("one", 2.5), ("tied", 1.0), ("tied", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "low": 0.0, "high": 1.0}
    out = k.exact_quantiles(df, "g", "x", shares, 2.0)
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = df.groupBy("g").agg(*(F.percentile("x", F.lit(q)).alias(n) for n, q in shares.items()))
    plain = lambda d: sorted(tuple(str(r[0]) if i == 0 else str(None if v is None else round(v, 9)) for i, v in enumerate(r)) for r in d.collect())
    assert plain(out) == plain(want)
    assert "Percentile" not in str(QUERIES["a23_describe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()).title()
