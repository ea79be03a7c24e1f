"""Messages to stock-day features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import AFTER_HOURS, MARKET_HOURS, SESSIONS, r6 as rounded
from ..plans import messages as m
from ..plans import stock_day as f
from ..sources import stand_in
from .prelude import CALENDAR, MESSAGES, ROUTED, query, r6

SYMBOL_DATE = ("symbol", "date")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.stock_messages(stand_in.messages(spark, sf_dir), stand_in.closes(spark))


def tidy(df: DataFrame, ints: tuple[str, ...] = ()) -> DataFrame:
    """Counts as long, doubles rounded, so that engines agree to the last digit shown."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") or c in ints else rounded(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


def daily_net_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(f.sentiment(rows(spark, sf_dir)))


def p1_tagged(spark, sf_dir):
    return m.tagged(stand_in.messages(spark, sf_dir)).select("message_id", "user_id", "sentiment")


def p2_p5_time_parts(spark, sf_dir):
    timed = m.route(m.with_time_parts(m.tagged(stand_in.messages(spark, sf_dir))), stand_in.closes(spark))
    return timed.select("message_id", F.col("hour").cast("long").alias("hour"), F.col("session").cast("long").alias("session"), "is_after_hours", "is_weekend", "is_holiday", F.col("local").cast("date").alias("local_date"))


def p6_session_group(spark, sf_dir):
    r = rows(spark, sf_dir)
    return r.select("message_id", "symbol", m.grouped_sessions(r).alias("session_group"))


def p8_j11_symbol_rows(spark, sf_dir):
    return rows(spark, sf_dir).select("message_id", "symbol", "date")


def w6_calendar_closes(spark, sf_dir):
    return stand_in.closes(spark)


def j1_route(spark, sf_dir):
    routed = m.route(m.with_time_parts(stand_in.messages(spark, sf_dir)), stand_in.closes(spark))
    return routed.groupBy("date").agg(F.count("*").alias("n_messages"), F.count_if("is_after_hours").alias("n_after_hours"))


def a3_a6_attention(spark, sf_dir):
    return tidy(f.attention(rows(spark, sf_dir), stand_in.trading_days(spark)))


def f03_abnormal_sentiment(spark, sf_dir):
    full = f.abnormal_sentiment(f.sentiment(rows(spark, sf_dir)), stand_in.trading_days(spark))
    return tidy(full.select(*SYMBOL_DATE, "net_sentiment", "n_bullish", "disagreement_index", *(c for c in full.columns if c.startswith("abnormal"))))


def f04_session_features(spark, sf_dir):
    return tidy(f.session_features(rows(spark, sf_dir)))


def _directions(spark, sf_dir):
    return f.daily_direction(rows(spark, sf_dir), stand_in.trading_days(spark))


def a10_daily_direction(spark, sf_dir):
    return tidy(_directions(spark, sf_dir))


def a11_flips(spark, sf_dir):
    return tidy(f.flips(_directions(spark, sf_dir)))


def a12_w8_conviction(spark, sf_dir):
    return tidy(f.conviction(_directions(spark, sf_dir)))


def a12_conviction_bounded(spark, sf_dir):
    return tidy(f.conviction(_directions(spark, sf_dir), history="bounded"))


def a13_first_movers(spark, sf_dir):
    return tidy(f.first_movers(rows(spark, sf_dir)))


def a14_a18_cohorts(spark, sf_dir):
    return tidy(f.cohorts(rows(spark, sf_dir), (5, 21)))


def f05_all_dynamics(spark, sf_dir):
    return tidy(f.dynamics(rows(spark, sf_dir), stand_in.trading_days(spark)))


_RATIO = lambda a, b: f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / {b} END"

_SENTIMENT = """
counts AS (SELECT symbol, date, count(*) FILTER (sentiment = 'Bullish') AS n_bullish, count(*) FILTER (sentiment = 'Bearish') AS n_bearish, count(*) AS total_labeled FROM rows_ GROUP BY ALL),
sentiment AS (SELECT *, n_bullish / total_labeled AS bullish_ratio, n_bearish / total_labeled AS bearish_ratio, (n_bullish - n_bearish) / total_labeled AS net_sentiment FROM counts)"""

_HORIZONS = (5, 21, 63, 250)


def _attention_sql() -> str:
    new = []
    for h in _HORIZONS:
        w = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"
        mean, sd = f"avg(raw_volume) OVER {w}", f"stddev_samp(raw_volume) OVER {w}"
        new += [f"{r6(f'raw_volume - {mean}')} AS abn_volume_{h}d", f"{r6(f'CASE WHEN {sd} > 0 THEN (raw_volume - {mean}) / {sd} ELSE 0 END')} AS abn_attention_std_{h}d", f"CAST(coalesce(raw_volume > {mean} + 2 * {sd}, false) AS BIGINT) AS attention_surge_{h}d"]
    w = "(PARTITION BY symbol ORDER BY date)"
    return query(
        ROUTED
        + """,
users AS (SELECT symbol, date, user_id, count(*) AS n, min(local) AS first, max(local) AS last FROM rows_ GROUP BY ALL),
facts AS (SELECT symbol, date, CAST(sum(n) AS BIGINT) AS raw_volume, count(*) AS unique_user_count,
    CASE WHEN sum(n) > 1 THEN (epoch_us(max(last)) - epoch_us(min(first))) / 1e6 / 3600 / (sum(n) - 1) END AS silence_gap_hours,
    sum(n * n) / (sum(n) * sum(n)) AS attention_hhi FROM users GROUP BY ALL),
grid AS (SELECT DISTINCT f.symbol, s.date FROM facts f, sess s WHERE year(s.date) IN (year(f.date), year(f.date) + 1)
    AND s.date BETWEEN (SELECT min(date) FROM facts) AND (SELECT max(date) FROM facts)),
filled AS (SELECT g.symbol, g.date, coalesce(raw_volume, 0) AS raw_volume, coalesce(unique_user_count, 0) AS unique_user_count, silence_gap_hours, attention_hhi, ln(1 + coalesce(raw_volume, 0)) AS log_volume
    FROM grid g LEFT JOIN facts f USING (symbol, date))""",
        f"""SELECT symbol, date, CAST(raw_volume AS BIGINT) AS raw_volume, CAST(unique_user_count AS BIGINT) AS unique_user_count, {r6("silence_gap_hours")} AS silence_gap_hours, {r6("attention_hhi")} AS attention_hhi,
    {r6("log_volume")} AS log_volume, CAST(raw_volume - lag(raw_volume) OVER {w} AS BIGINT) AS volume_diff, {r6(f"log_volume - lag(log_volume) OVER {w}")} AS log_volume_change, {", ".join(new)},
    {r6("CASE WHEN sum(raw_volume) OVER (PARTITION BY date) > 0 THEN raw_volume / sum(raw_volume) OVER (PARTITION BY date) ELSE 0 END")} AS relative_volume FROM filled""",
    )


def _abnormal_sql() -> str:
    avg = lambda h: f"avg(net_sentiment) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"
    new = [f"{r6('net_sentiment - lag(net_sentiment) OVER (PARTITION BY symbol ORDER BY date)')} AS abnormal_sentiment_1d", *(f"{r6(f'net_sentiment - {avg(h)}')} AS abnormal_sentiment_{h}d" for h in _HORIZONS)]
    return query(
        ROUTED + "," + _SENTIMENT + """,
filled AS (SELECT g.symbol, s.date, coalesce(n_bullish, 0) AS n_bullish, coalesce(net_sentiment, 0) AS net_sentiment, 1 - abs(f.net_sentiment) AS disagreement
    FROM (SELECT DISTINCT symbol FROM sentiment) g CROSS JOIN sess s LEFT JOIN sentiment f ON f.symbol = g.symbol AND f.date = s.date)""",
        f"SELECT symbol, date, {r6('net_sentiment')} AS net_sentiment, n_bullish, {r6('disagreement')} AS disagreement_index, {', '.join(new)} FROM filled",
    )


_GROUP = (
    "CASE WHEN is_weekend THEN 'weekend' WHEN is_holiday THEN 'holiday' "
    + " ".join(f"WHEN business_day AND session < {end} THEN '{name}'" for (name, _), end in zip(SESSIONS, [s for _, s in SESSIONS[1:]] + [2400], strict=True))
    + " ELSE 'unknown' END"
)


def _sessions_sql() -> str:
    groups = [name for name, _ in SESSIONS] + ["weekend", "holiday"]

    def pair(names, prefix):
        among = "g IN (" + ", ".join(f"'{n}'" for n in names) + ")"
        n, bull, bear = f"count(*) FILTER ({among})", f"count(*) FILTER ({among} AND sentiment = 'Bullish')", f"count(*) FILTER ({among} AND sentiment = 'Bearish')"
        return f"{n} AS {prefix}_volume, CASE WHEN {bull} + {bear} > 0 THEN ({bull} - {bear}) / ({bull} + {bear}) ELSE 0.0 END AS {prefix}_sentiment"

    parts = [pair(AFTER_HOURS, "after_hours"), pair(MARKET_HOURS, "market_hours"), *(pair([g], g) for g in groups)]
    names = ["after_hours", "market_hours", *groups]
    values = "[" + ", ".join(f"{name}_sentiment" for name, _ in SESSIONS) + "]"
    return query(
        ROUTED + f", grouped AS (SELECT *, {_GROUP} AS g FROM rows_), wide AS (SELECT symbol, date, {', '.join(parts)} FROM grouped GROUP BY symbol, date)",
        f"SELECT symbol, date, {', '.join(f'{n}_volume, {r6(f'{n}_sentiment')} AS {n}_sentiment' for n in names)}, {r6(f'list_stddev_samp({values})')} AS intraday_sentiment_volatility FROM wide",
    )


_DIRECTIONS = """
directions AS (SELECT user_id, symbol, date, CASE WHEN sum(CASE WHEN sentiment = 'Bullish' THEN 1 ELSE -1 END) > 0 THEN 1 ELSE -1 END AS direction FROM rows_ GROUP BY ALL),
coded AS (SELECT d.*, s.code FROM directions d LEFT JOIN sess s USING (date))"""


def _flips_sql() -> str:
    w = "(PARTITION BY user_id, symbol ORDER BY date)"
    parts = []
    for h in _HORIZONS:
        up, down = f"count(*) FILTER (was = -1 AND direction = 1 AND gap <= {h})", f"count(*) FILTER (was = 1 AND direction = -1 AND gap <= {h})"
        parts += [f"{up} AS bear_to_bull_flips_{h}, {down} AS bull_to_bear_flips_{h}, {up} - {down} AS net_flip_count_{h}, {r6(f'{up} / count(*)')} AS bear_to_bull_ratio_{h}, {r6(f'{down} / count(*)')} AS bull_to_bear_ratio_{h}"]
    return query(ROUTED + "," + _DIRECTIONS + f", moved AS (SELECT *, lag(direction) OVER {w} AS was, code - lag(code) OVER {w} AS gap FROM coded)", f"SELECT symbol, date, {', '.join(parts)} FROM moved GROUP BY symbol, date")


_STREAKS = """
turned AS (SELECT *, coalesce(CAST(direction <> lag(direction) OVER (PARTITION BY user_id, symbol ORDER BY date) AS INTEGER), 1) AS turn FROM coded),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY user_id, symbol ORDER BY date) AS run FROM turned),
streaks AS (SELECT *, row_number() OVER (PARTITION BY user_id, symbol, run ORDER BY date) AS streak FROM runs)"""

_CONVICTION = query(ROUTED + "," + _DIRECTIONS + "," + _STREAKS, "SELECT symbol, date, " + ", ".join(f"{r6(f'avg(CAST(streak >= {k} AS INTEGER))')} AS conviction_index_{k}" for k in (3, 5, 10)) + " FROM streaks GROUP BY symbol, date")

_FIRST = query(
    ROUTED + ", numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY local, message_id) AS nth FROM rows_)",
    "SELECT symbol, date, " + ", ".join(f"{r6(f'avg(CASE WHEN sentiment = ' + chr(39) + 'Bullish' + chr(39) + f' THEN 1 ELSE -1 END) FILTER (nth <= {n})')} AS first_mover_net_sent_{n}, count(*) FILTER (nth <= {n}) AS first_mover_volume_{n}" for n in (5, 10, 50)) + " FROM numbered GROUP BY symbol, date",
)


def _cohorts_sql(horizons=(5, 21)) -> str:
    parts = []
    for h in horizons:
        reach = h * 365 / 252
        fresh, back, stay = f"count(*) FILTER (gap IS NULL OR gap > {reach!r})", f"count(*) FILTER (gap > {reach!r})", f"count(*) FILTER (gap <= {reach!r})"
        parts += [f"{fresh} AS fresh_blood_count_{h}, {r6(f'{fresh} / count(*)')} AS fresh_blood_ratio_{h}, {back} AS reentry_volume_{h}, {r6(f'{stay} / count(*)')} AS retention_rate_{h}"]
    share = "CASE WHEN before > 0 THEN ah_before / before END"
    mean = lambda c: r6(f"avg(CAST(coalesce({c}, false) AS INTEGER))")
    return query(
        ROUTED
        + """,
posts AS (SELECT *, row_number() OVER o - 1 AS before, coalesce(sum(CAST(is_after_hours AS INTEGER)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ah_before
    FROM rows_ WINDOW o AS (PARTITION BY user_id ORDER BY date, local, message_id, symbol)),
daily AS (SELECT user_id, symbol, date, count(*) AS n FROM rows_ GROUP BY ALL),
seen AS (SELECT *, date - lag(date) OVER (PARTITION BY user_id, symbol ORDER BY date) AS gap, row_number() OVER (PARTITION BY symbol, date ORDER BY n, user_id) AS r FROM daily),
firsts AS (SELECT user_id, symbol, min(date) AS first FROM daily GROUP BY ALL),
known AS (SELECT u.user_id, u.date, count(f.first) AS n_known FROM (SELECT DISTINCT user_id, date FROM daily) u LEFT JOIN firsts f ON f.user_id = u.user_id AND f.first < u.date GROUP BY ALL),
whale AS (SELECT date, quantile_cont(before, 0.99) AS whale_at FROM posts GROUP BY date),"""
        + f"""
by_post AS (SELECT symbol, date, count(*) AS n_posts, {mean("before >= whale_at")} AS whale_dominance, {mean("before < 5")} AS minnow_dominance, {mean(f"{share} > 0.8")} AS night_owl_ratio,
    {mean(f"{share} < 0.2")} AS day_trader_ratio, {mean("n_known <= 3")} AS specialist_ratio FROM posts JOIN whale USING (date) JOIN known USING (user_id, date) GROUP BY symbol, date),
by_user AS (SELECT symbol, date, {r6("2 * sum(r * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*)")} AS crowding_gini, {", ".join(parts)} FROM seen GROUP BY symbol, date)""",
        "SELECT * FROM by_post JOIN by_user USING (symbol, date)",
    )


def _dynamics_sql() -> str:
    parts = {"flips": _flips_sql(), "convinced": _CONVICTION, "first_posts": _FIRST, "cohorts": _cohorts_sql((21, 63))}
    return query(", ".join(f"{name} AS ({sql})" for name, sql in parts.items()), "SELECT * FROM flips JOIN convinced USING (symbol, date) JOIN first_posts USING (symbol, date) JOIN cohorts USING (symbol, date)")


QUERIES = {
    "daily_net_sentiment": (daily_net_sentiment, query(ROUTED + "," + _SENTIMENT, f"SELECT symbol, date, n_bullish, n_bearish, total_labeled, {r6('bullish_ratio')} AS bullish_ratio, {r6('bearish_ratio')} AS bearish_ratio, {r6('net_sentiment')} AS net_sentiment, " + ", ".join(f"CAST({s}_ratio > {p / 100} AS BIGINT) AS extreme_{s}_{p}" for s in ("bullish", "bearish") for p in (80, 90)) + f", {r6('1 - abs(net_sentiment)')} AS disagreement_index FROM sentiment")),
    "p1_tagged": (p1_tagged, query(MESSAGES, "SELECT message_id, user_id, sentiment FROM messages WHERE sentiment IN ('Bullish', 'Bearish')")),
    "p2_p5_time_parts": (p2_p5_time_parts, query(ROUTED, "SELECT message_id, hour(local) AS hour, CAST(session AS BIGINT) AS session, is_after_hours, is_weekend, is_holiday, local_date FROM routed WHERE date IS NOT NULL")),
    "p6_session_group": (p6_session_group, query(ROUTED, f"SELECT message_id, symbol, {_GROUP} AS session_group FROM rows_")),
    "p8_j11_symbol_rows": (p8_j11_symbol_rows, query(ROUTED, "SELECT message_id, symbol, date FROM rows_")),
    "w6_calendar_closes": (w6_calendar_closes, query(CALENDAR, "SELECT date, business_day, first_close, second_close FROM closes")),
    "j1_route": (j1_route, query(ROUTED.replace("FROM messages WHERE sentiment IN ('Bullish', 'Bearish')", "FROM messages"), "SELECT date, count(*) AS n_messages, count(*) FILTER (is_after_hours) AS n_after_hours FROM routed WHERE date IS NOT NULL GROUP BY date")),
    "a3_a6_attention": (a3_a6_attention, _attention_sql()),
    "f03_abnormal_sentiment": (f03_abnormal_sentiment, _abnormal_sql()),
    "f04_session_features": (f04_session_features, _sessions_sql()),
    "a10_daily_direction": (a10_daily_direction, query(ROUTED + "," + _DIRECTIONS, "SELECT user_id, symbol, date, CAST(direction AS BIGINT) AS direction, CAST(code AS BIGINT) AS code FROM coded")),
    "a11_flips": (a11_flips, _flips_sql()),
    "a12_w8_conviction": (a12_w8_conviction, _CONVICTION),
    "a12_conviction_bounded": (a12_conviction_bounded, _CONVICTION),
    "a13_first_movers": (a13_first_movers, _FIRST),
    "a14_a18_cohorts": (a14_a18_cohorts, _cohorts_sql()),
    "f05_all_dynamics": (f05_all_dynamics, _dynamics_sql()),
}
