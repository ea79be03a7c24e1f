"""Stock-day features: sentiment, attention, abnormal sentiment, sessions, flips and conviction, cohorts, vectors.

Inputs are (message, symbol) rows: message_id, user_id, symbol, date, local, sentiment, session,
is_after_hours, business_day, is_weekend, is_holiday. Every table is a few aggregations and windows
on (symbol, date) or on the user; there is no loop over years.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import AFTER_HOURS, MARKET_HOURS, SESSIONS, ratio, row_stddev
from ..operators.asof import count_before
from ..operators.grid import complete, fill_grid, rolled, with_running
from ..operators.guards import head_by
from .messages import grouped_sessions

KEYS = ["symbol", "date"]
HORIZONS = (5, 21, 63, 250)
TRADING_YEAR = 252


def _bull() -> Column:
    return F.count_if(F.col("sentiment") == "Bullish")


def _bear() -> Column:
    return F.count_if(F.col("sentiment") == "Bearish")


def sentiment(rows: DataFrame) -> DataFrame:
    """Counts, ratios, extreme consensus and disagreement, on days with messages."""
    counts = rows.groupBy(*KEYS).agg(_bull().alias("n_bullish"), _bear().alias("n_bearish")).withColumn("total_labeled", F.col("n_bullish") + F.col("n_bearish"))
    bull, bear = ratio(F.col("n_bullish"), F.col("total_labeled")), ratio(F.col("n_bearish"), F.col("total_labeled"))
    net = ratio(F.col("n_bullish") - F.col("n_bearish"), F.col("total_labeled"))
    out = counts.withColumns({"bullish_ratio": bull, "bearish_ratio": bear, "net_sentiment": net})
    for side in ("bullish", "bearish"):
        for percent in (80, 90):
            out = out.withColumn(f"extreme_{side}_{percent}", F.coalesce(F.col(f"{side}_ratio") > percent / 100, F.lit(False)).cast("int"))
    return out.withColumn("disagreement_index", 1 - F.abs("net_sentiment"))


def attention(rows: DataFrame, sessions: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Volume, users, changes, abnormal attention, gaps, market share and concentration on the complete grid.

    The grid has each symbol on the sessions of the years in which, or after which, it has a message.
    """
    users = rows.groupBy(*KEYS, "user_id").agg(F.count("*").alias("n"), F.min("local").alias("first"), F.max("local").alias("last"))
    span = F.timestamp_diff("MICROSECOND", F.min("first"), F.max("last")) / 3.6e9
    facts = users.groupBy(*KEYS).agg(
        F.sum("n").alias("raw_volume"),
        F.count("*").alias("unique_user_count"),
        F.when(F.sum("n") > 1, span / (F.sum("n") - 1)).alias("silence_gap_hours"),
        (F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))).alias("attention_hhi"),
    )
    active = facts.select("symbol", F.explode(F.array(F.year("date"), F.year("date") + 1)).alias("year")).distinct()
    inside = sessions.join(facts.agg(F.min("date").alias("low"), F.max("date").alias("high")), F.col("date").between(F.col("low"), F.col("high"))).select("date")
    grid = active.join(F.broadcast(inside.withColumn("year", F.year("date"))), "year").select(*KEYS)
    full = fill_grid(grid, facts, KEYS, ["raw_volume", "unique_user_count"]).withColumn("log_volume", F.log1p("raw_volume"))
    w = Window.partitionBy("symbol").orderBy("date")
    full = full.withColumns({"volume_diff": F.col("raw_volume") - F.lag("raw_volume").over(w), "log_volume_change": F.col("log_volume") - F.lag("log_volume").over(w)})
    v = F.col("raw_volume")
    full = with_running(full, ["symbol"], "date", v_n=F.lit(1), v_sum=v, v_squares=v * v)
    new = {}
    for h in horizons:
        n, total, squares = (rolled(c, ["symbol"], "date", h) for c in ("v_n", "v_sum", "v_squares"))
        mean = total / n
        # whole numbers up to the division, so a constant volume has a deviation of exactly zero
        sd = F.when(n > 1, F.sqrt((n * squares - total * total) / (n * (n - 1))))
        new[f"abn_volume_{h}d"] = v - mean
        new[f"abn_attention_std_{h}d"] = F.when(sd > 0, (v - mean) / sd).otherwise(0.0)
        new[f"attention_surge_{h}d"] = F.coalesce(v > mean + 2 * sd, F.lit(False)).cast("int")
    new["relative_volume"] = ratio(F.col("raw_volume"), F.sum("raw_volume").over(Window.partitionBy("date")), 0.0)
    return full.withColumns(new).drop("v_n", "v_sum", "v_squares")


def abnormal_sentiment(daily: DataFrame, sessions: DataFrame, horizons: Sequence[int] = (1, *HORIZONS)) -> DataFrame:
    """Sentiment on the full grid, silence neutral, and its deviation from rolling means (horizon 1: change)."""
    counts = ["n_bullish", "n_bearish", "total_labeled", "extreme_bullish_80", "extreme_bullish_90", "extreme_bearish_80", "extreme_bearish_90", "net_sentiment"]
    full = fill_grid(complete(daily.select("symbol").distinct(), sessions.select("date")), daily, KEYS, counts)
    w = Window.partitionBy("symbol").orderBy("date")
    full = with_running(full, ["symbol"], "date", s_n=F.lit(1), s_sum=F.col("net_sentiment"))
    mean = lambda h: rolled("s_sum", ["symbol"], "date", h) / rolled("s_n", ["symbol"], "date", h)
    new = {f"abnormal_sentiment_{h}d": F.col("net_sentiment") - (F.lag("net_sentiment").over(w) if h == 1 else mean(h)) for h in horizons}
    return full.withColumns(new).drop("s_n", "s_sum")


def session_features(rows: DataFrame) -> DataFrame:
    """Volume and net sentiment of ten session groups, after and within market hours, and their dispersion."""
    groups = [name for name, _ in SESSIONS] + ["weekend", "holiday"]
    counts = rows.withColumn("g", grouped_sessions(rows)).groupBy(*KEYS).pivot("g", groups).agg(F.count("message_id").alias("n"), _bull().alias("bull"), _bear().alias("bear"))
    value = lambda g, what: F.coalesce(F.col(f"{g}_{what}"), F.lit(0))
    total = lambda names, what: reduce(lambda a, b: a + b, (value(g, what) for g in names))
    pair = lambda names, prefix: {f"{prefix}_volume": total(names, "n"), f"{prefix}_sentiment": ratio(total(names, "bull") - total(names, "bear"), total(names, "bull") + total(names, "bear"), 0.0)}
    out = pair(AFTER_HOURS, "after_hours") | pair(MARKET_HOURS, "market_hours")
    for g in groups:
        out |= pair([g], g)
    features = counts.select(*KEYS, *(c.alias(name) for name, c in out.items()))
    return features.withColumn("intraday_sentiment_volatility", row_stddev([F.col(f"{name}_sentiment") for name, _ in SESSIONS]))


def daily_direction(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """user_id, symbol, date, code, direction: the day's majority, a tie counts as bearish."""
    signs = rows.where(F.col("sentiment").isin("Bullish", "Bearish")).groupBy("user_id", *KEYS).agg(F.sum(F.when(F.col("sentiment") == "Bullish", 1).otherwise(-1)).alias("s"))
    return signs.select("user_id", *KEYS, F.when(F.col("s") > 0, 1).otherwise(-1).alias("direction")).join(F.broadcast(sessions.select("date", "code")), "date", "left")


def _flip_counts(horizons: Sequence[int]) -> dict[str, Column]:
    """Reversals by horizon, of rows with direction, before and gap."""
    up, down = (F.col("before") == -1) & (F.col("direction") == 1), (F.col("before") == 1) & (F.col("direction") == -1)
    return {f"{name}_flips_{h}": F.count_if(turned & (F.col("gap") <= h)) for h in horizons for name, turned in (("bear_to_bull", up), ("bull_to_bear", down))}


def _with_flip_shares(counts: DataFrame, horizons: Sequence[int]) -> DataFrame:
    for h in horizons:
        up, down = (F.col(f"{name}_flips_{h}") for name in ("bear_to_bull", "bull_to_bear"))
        counts = counts.withColumns({f"net_flip_count_{h}": up - down, f"bear_to_bull_ratio_{h}": ratio(up, F.col("n_users")), f"bull_to_bear_ratio_{h}": ratio(down, F.col("n_users"))})
    return counts.drop("n_users")


def flips(directions: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Reversals within a horizon of sessions since the user's last tagged day, and their share of users."""
    w = Window.partitionBy("user_id", "symbol").orderBy("date")
    moved = directions.withColumns({"before": F.lag("direction").over(w), "gap": F.col("code") - F.lag("code").over(w)})
    counts = moved.groupBy(*KEYS).agg(F.count("*").alias("n_users"), *(c.alias(name) for name, c in _flip_counts(horizons).items()))
    return _with_flip_shares(counts, horizons)


def streaks(directions: DataFrame, history: str = "full", reach: int = 250) -> DataFrame:
    """Adds ``streak``: the user's consecutive tagged days of one direction on the symbol, today included.

    ``history='bounded'`` counts only days of this year, and of the last year's within ``reach`` sessions
    of its end, as a yearly run that carries so much would.
    """
    w = Window.partitionBy("user_id", "symbol").orderBy("date")
    turned = directions.withColumn("turn", F.coalesce((F.col("direction") != F.lag("direction").over(w)).cast("int"), F.lit(1)))
    runs = turned.withColumn("run", F.sum("turn").over(w))
    if history == "full":
        return runs.withColumn("streak", F.row_number().over(Window.partitionBy("user_id", "symbol", "run").orderBy("date")))
    # Days of the run before those that count, at the first day of each year: what is more than a year's key and the reach
    # behind. The key parts years by more than any session number, so last year's sessions, and only they, are within it.
    apart = 1 << 32
    keyed = runs.withColumn("key", F.year("date").cast("long") * apart + F.col("code"))
    run = Window.partitionBy("user_id", "symbol", "run")
    counted = keyed.withColumns({"place": F.row_number().over(run.orderBy("key")), "lost": F.count("*").over(run.orderBy("key").rangeBetween(Window.unboundedPreceding, -(apart + reach + 1)))})
    first_lost = F.first("lost").over(Window.partitionBy("user_id", "symbol", "run", F.year("date")).orderBy("key"))
    return counted.withColumn("streak", (F.col("place") - first_lost).cast("int")).drop("key", "place", "lost")


def conviction(directions: DataFrame, least: Sequence[int] = (3, 5, 10), history: str = "full") -> DataFrame:
    """Share of the day's tagged users with a streak of at least K."""
    return streaks(directions, history).groupBy(*KEYS).agg(*_convinced(least))


def _convinced(least: Sequence[int]) -> list[Column]:
    return [F.avg((F.col("streak") >= k).cast("int")).alias(f"conviction_index_{k}") for k in least]


def first_movers(rows: DataFrame, firsts: Sequence[int] = (5, 10, 50)) -> DataFrame:
    """Net sentiment and volume of the first N tagged posts of the stock-day; ties in time go by message."""
    posts = rows.where(F.col("sentiment").isin("Bullish", "Bearish"))
    w = Window.partitionBy(*KEYS).orderBy("local", "message_id")
    early = posts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max(firsts))
    sign = F.when(F.col("sentiment") == "Bullish", 1).otherwise(-1)
    return early.groupBy(*KEYS).agg(*(a for n in firsts for a in (F.avg(F.when(F.col("nth") <= n, sign)).alias(f"first_mover_net_sent_{n}"), F.count_if(F.col("nth") <= n).alias(f"first_mover_volume_{n}"))))


def _by_post(rows: DataFrame) -> DataFrame:
    """Shares of the stock-day's posts by what their users did before.

    Prior posts are all earlier (message, symbol) rows of the user in the order date, time, message, symbol. Both they and
    the symbols known before a day are counted where the user's posts are: one exchange by user.
    """
    order = Window.partitionBy("user_id").orderBy("date", "local", "message_id", "symbol")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("user_id", "symbol").orderBy("date", "local", "message_id")) == 1
    posts = rows.repartition("user_id").withColumn("first", first.cast("int"))
    posts = posts.withColumns({"before": F.row_number().over(order) - 1, "ah_before": F.coalesce(F.sum(F.col("is_after_hours").cast("int")).over(prior), F.lit(0))})
    posts = count_before(posts, ["user_id"], "date", "first", "n_known")
    whale = posts.groupBy("date").agg(F.percentile("before", 0.99).alias("whale_at"))
    share = F.when(F.col("before") > 0, F.col("ah_before") / F.col("before"))
    mean = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return posts.join(F.broadcast(whale), "date").groupBy(*KEYS).agg(  # a row a date
        F.count("*").alias("n_posts"),
        mean(F.col("before") >= F.col("whale_at")).alias("whale_dominance"),
        mean(F.col("before") < 5).alias("minnow_dominance"),
        mean(share > 0.8).alias("night_owl_ratio"),
        mean(share < 0.2).alias("day_trader_ratio"),
        mean(F.col("n_known") <= 3).alias("specialist_ratio"),
    )


def _ranked(user_days: DataFrame) -> DataFrame:
    """Adds the rank ``r`` of a user among those of the stock-day by posts."""
    return user_days.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy("n", "user_id")))


def _attendance(horizons: Sequence[int]) -> list[Column]:
    """Crowding, newcomers and returns, of rows with the user's posts n, rank r and calendar days ``since`` the last such row."""
    aggs = [(2 * F.sum(F.col("r") * F.col("n")) / (F.count("*") * F.sum("n")) - (F.count("*") + 1) / F.count("*")).alias("crowding_gini")]
    for h in horizons:
        reach = h * 365 / TRADING_YEAR
        fresh, back, stay = F.col("since").isNull() | (F.col("since") > reach), F.col("since") > reach, F.col("since") <= reach
        aggs += [F.count_if(fresh).alias(f"fresh_blood_count_{h}"), (F.count_if(fresh) / F.count("*")).alias(f"fresh_blood_ratio_{h}"), F.count_if(back).alias(f"reentry_volume_{h}"), (F.count_if(stay) / F.count("*")).alias(f"retention_rate_{h}")]
    return aggs


def cohorts(rows: DataFrame, horizons: Sequence[int] = (21, 63)) -> DataFrame:
    """Who talks: newcomers, returns, whales, minnows, night owls, day traders, specialists, and crowding."""
    w = Window.partitionBy("user_id", "symbol").orderBy("date")
    daily = rows.groupBy("user_id", *KEYS).agg(F.count("*").alias("n")).withColumn("since", F.datediff("date", F.lag("date").over(w)))
    return _by_post(rows).join(_ranked(daily).groupBy(*KEYS).agg(*_attendance(horizons)), KEYS)


def dynamics(rows: DataFrame, sessions: DataFrame, horizons: Sequence[int] = HORIZONS, least: Sequence[int] = (3, 5, 10), firsts: Sequence[int] = (5, 10, 50), reaches: Sequence[int] = (21, 63)) -> DataFrame:
    """What flips, conviction, first_movers and cohorts give, on every stock-day with a message.

    A user's day on a symbol is made once, with one exchange and one order for reversals, streaks and returns, and
    aggregated once by stock-day. Where nobody is tagged, what counts tagged users is null.
    """
    w = Window.partitionBy("user_id", "symbol").orderBy("date")
    past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("sentiment") == "Bullish", 1).when(F.col("sentiment") == "Bearish", -1)
    days = rows.groupBy("user_id", *KEYS).agg(F.count("*").alias("n"), F.sum(sign).alias("s"))
    days = days.withColumn("direction", F.when(F.col("s") > 0, 1).when(F.col("s") <= 0, -1)).join(F.broadcast(sessions.select("date", "code")), "date", "left")
    tagged = F.col("direction").isNotNull()
    days = days.withColumns({"last": F.last(F.when(tagged, F.struct("direction", "code")), ignorenulls=True).over(past), "since": F.datediff("date", F.lag("date").over(w)), "seen": F.count("direction").over(upto)})
    days = days.withColumns({"before": F.col("last.direction"), "gap": F.col("code") - F.col("last.code")})
    turned = tagged & ~F.col("before").eqNullSafe(F.col("direction"))
    days = days.withColumn("start", F.last(F.when(turned, F.col("seen")), ignorenulls=True).over(upto))
    days = days.withColumn("streak", F.when(tagged, F.col("seen") - F.col("start") + 1))
    known = {name: F.when(F.count("direction") > 0, c) for name, c in _flip_counts(horizons).items()}
    by_user = _ranked(days).groupBy(*KEYS).agg(F.count("direction").alias("n_users"), *(c.alias(name) for name, c in known.items()), *_convinced(least), *_attendance(reaches))
    return _with_flip_shares(by_user, horizons).join(first_movers(rows, firsts), KEYS, "left").join(_by_post(rows), KEYS)


def mean_vectors(members: DataFrame, by: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Mean vector and count of each group. Components are summed as rows of (group, place): partial sums
    are made before the shuffle, so a group of any size moves as one row per task and place."""
    flat = members.select(*by, F.posexplode(vector).alias("place", "x"))
    sums = flat.groupBy(*by, "place").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return sums.groupBy(*by).agg(F.max("n").alias("embed_n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda p: p["m"]).alias("mean_vector"))


def word_frequency(rows: DataFrame, words: str, by: Sequence[str], n: int) -> DataFrame:
    """The n most frequent words of each group, ties by word."""
    counts = rows.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    return head_by(counts, by, [F.desc("n"), "word"], n)
