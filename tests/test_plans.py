"""What the plans look like: pushed filters, pruned columns, one shuffle where one is enough."""

import re

from pyspark.sql import functions as F

from sigspark.operators import guards
from sigspark.plans import evaluation as ev
from sigspark.plans import messages as m
from sigspark.plans import stock_day as f
from sigspark.sources import stand_in

from conftest import TINY


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffles(frame):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(frame))


def rows(spark):
    return m.stock_messages(stand_in.messages(spark, TINY), stand_in.closes(spark))


def test_sentiment_is_one_shuffle_with_partial_counts(spark):
    p = f.sentiment(rows(spark))
    assert len(shuffles(p)) == 1 and "partial_count" in plan(p)


def test_the_calendar_is_sent_out_and_columns_are_pruned(spark):
    p = plan(rows(spark).select("symbol", "date"))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "value:double" not in p and "user_id" not in p


def test_first_rows_of_groups_limit_them_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(guards.head_by(spark.read.parquet(f"{TINY}/orders.parquet"), ["o_custkey"], [F.desc("o_totalprice")], 3))
    assert "WindowGroupLimit" in plan(guards.first_by(spark.read.parquet(f"{TINY}/orders.parquet"), ["o_custkey"], ["o_orderkey"]))


def test_all_models_are_scored_on_one_key(spark):
    keys = shuffles(ev.rank_ic(stand_in.forecasts(spark, TINY).select("date", "model_id", "prediction", "y"), "prediction", "y", ("date", "model_id")))
    # the panel's own aggregation, then ranks, ties and sums on the cross-section or finer
    assert sum("model_id" in k for k in keys) <= 4 and all("model_id" in k or "l_suppkey" in k or "_groupingexpression" in k for k in keys)


def test_windows_of_one_key_share_a_shuffle(spark):
    w = f.cohorts(rows(spark))
    assert len(shuffles(w)) <= 14
    flips = f.flips(f.daily_direction(rows(spark), stand_in.trading_days(spark)))
    assert len([k for k in shuffles(flips) if "user_id" in k]) <= 2


def test_all_dynamics_share_their_tables(spark):
    p = f.dynamics(rows(spark), stand_in.trading_days(spark))
    keys = shuffles(p)
    # user days, summed in the tasks first, and their order; posts by user, and the few columns of them that a date's limit needs
    assert len(keys) <= 8 and len([k for k in keys if "user_id" in k]) <= 4
    assert plan(p).count("SortMergeJoin") <= 2


def test_no_python_in_feature_plans(spark):
    for p in (f.sentiment(rows(spark)), f.cohorts(rows(spark)), f.session_features(rows(spark)), f.attention(rows(spark), stand_in.trading_days(spark)), ev.fractional_bins(stand_in.forecasts(spark, TINY), "prediction", "y", ("date", "model_id"))):
        assert not re.search("Python|Pandas|Arrow", plan(p))
