"""The training panel: market rows, abnormal returns, features, fills, controls and label repair."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import with_ranks
from ..functions.scalar import finite
from ..operators.grid import adjacent, back_fill, blocked, rolled, session_index, with_blocks, with_running
from ..sources.scratch import stored

# The feature families' default fills. A column is filled if its name holds one of these parts.
FILLS = (
    ("silence_gap_hours", 120.0),
    ("volume", 0.0),
    ("count", 0.0),
    ("n_bullish", 0.0),
    ("n_bearish", 0.0),
    ("total_labeled", 0.0),
    ("sentiment", 0.0),
    ("abn", 0.0),
    ("extreme", 0.0),
    ("surge", 0.0),
    ("disagreement_index", 0.0),
    ("attention_hhi", 0.0),
    ("to_bull", 0.0),
    ("to_bear", 0.0),
    ("flip", 0.0),
    ("conviction_index", 0.0),
    ("first_mover_net_sent", 0.0),
    ("fresh_blood_ratio", 0.0),
    ("whale_dominance", 0.0),
    ("minnow_dominance", 0.0),
    ("night_owl_ratio", 0.0),
    ("day_trader_ratio", 0.0),
    ("retention_rate", 0.0),
    ("crowding_gini", 0.0),
    ("specialist_ratio", 0.0),
)
# Columns dropped because others determine them.
COLLINEAR = ("n_bullish", "n_bearish", "bullish_ratio", "bearish_ratio", "total_labeled", "after_hours_volume", "market_hours_volume", "raw_volume")
KEYS_AND_TARGETS = ("permno", "ticker", "symbol", "date", "index")


def fill_by_name(df: DataFrame, fills: Sequence[tuple[str, float]] = FILLS) -> DataFrame:
    """Fill numeric feature columns by name pattern; keys, targets and columns that fit none stay."""
    values = {}
    for c in feature_columns(df):
        value = next((v for part, v in fills if part in c), None)
        if value is not None:
            values[c] = value
    return df.na.fill(values) if values else df


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns other than keys, cumulative returns and abnormal returns."""
    numeric = ("bigint", "int", "smallint", "tinyint", "double", "float")
    return [c for c, kind in df.dtypes if kind in numeric and c not in KEYS_AND_TARGETS and not c.startswith(("ar_", "f_"))]


def drop_collinear(df: DataFrame, names: Sequence[str] = COLLINEAR) -> DataFrame:
    return df.drop(*names)


def join_features(market: DataFrame, features: DataFrame) -> DataFrame:
    """Every market row with its ticker's features; two stocks of a ticker both get them."""
    return market.join(features.withColumnRenamed("symbol", "ticker"), ["ticker", "date"], "left")


def abnormal_return(df: DataFrame, horizon: int, benchmark: str | None = None, daily: str | None = None, strict: bool = True) -> Column:
    """Cumulative minus benchmark return, or the sum of daily abnormal returns of days 1 to ``horizon``.

    ``strict`` needs every day; otherwise missing days count as zero.
    """
    if benchmark is not None:
        return F.col(f"f_cumret{horizon}") - F.col(benchmark)
    days = [finite(F.col(f"{daily}{k}").cast("double")) for k in range(1, horizon + 1)]
    total = F.lit(0.0)
    for d in days:
        total = total + (d if strict else F.coalesce(d, F.lit(0.0)))
    return total


def forward_returns(market: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """f_cumret{h}: compound return of the stock's next h rows, null unless it has so many."""
    new = {}
    for h in horizons:
        ahead = Window.partitionBy("permno").orderBy("date").rowsBetween(1, h)
        new[f"f_cumret{h}"] = F.when(F.count("ret").over(ahead) == h, F.expm1(F.sum(F.log1p(F.col("ret"))).over(ahead)))
    return market.withColumns(new)


def neighbours(market: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """lag_cap, next_session_ret and next_is_next_session, null or false across session gaps."""
    coded = market.join(F.broadcast(sessions if sessions is not None else session_index(market)), "date")
    w = Window.partitionBy("permno").orderBy("code")
    return coded.withColumns({"lag_cap": adjacent(F.col("cap"), ["permno"], "code"), "next_session_ret": adjacent(F.col("ret"), ["permno"], "code", -1), "next_is_next_session": F.coalesce(F.lead("code").over(w) == F.col("code") + 1, F.lit(False))})


def repair_labels(panel: DataFrame, labels: Sequence[str], last_code: Column) -> DataFrame:
    """Labels become null where the stock's next row is not the next session; the last session is not judged."""
    bad = ~F.col("next_is_next_session") & (F.col("code") < last_code)
    return panel.withColumns({c: F.when(~bad, F.col(c)) for c in labels})


def exclude_gaps(panel: DataFrame, gaps: DataFrame, horizon: int, labels: Sequence[str]) -> DataFrame:
    """Labels become null where (t, t + horizon] meets a gap [first, last] of the stock's sessions.

    ``gaps``: permno, first_missing, last_missing. Sessions met are listed from the gaps' side, so that
    the join is one of equality.
    """
    hit = gaps.select("permno", F.explode(F.sequence(F.col("first_missing") - horizon, F.col("last_missing") - 1)).alias("code")).distinct().withColumn("__gap", F.lit(True))
    return panel.join(hit, ["permno", "code"], "left").withColumns({c: F.when(F.col("__gap").isNull(), F.col(c)) for c in labels}).drop("__gap")


CONTROL_RETURNS = (1, 5, 21, 63, 126, 252)


def _compound(h: int) -> Column:
    """Product of the gross returns of a full frame, less one; a gross return of zero gives -1."""
    part = lambda running: rolled(running, ["permno"], "code", h)
    return F.when(part("r_count") == h, F.when(part("r_zeros") > 0, F.lit(-1.0)).otherwise(F.expm1(part("r_logs"))))


ROWS_A_TASK = 250_000  # of a grid, so that what a task sorts does not grow with the data


def own_spans(market: DataFrame, cal: DataFrame) -> DataFrame:
    """Every stock's rows on all sessions from its first date to its last, with ``code``; absent sessions have nulls.

    A row fills the sessions up to the stock's next row, so the grid needs no join and no exchange beyond the one by stock. The
    number of tasks is that of the grid's rows by ``ROWS_A_TASK``: Spark sizes tasks by shuffled bytes, before rows are filled in.
    """
    dates = market.select("date").where(F.col("date").isNotNull()).distinct().join(F.broadcast(cal.select("date", "code")), "date", "full_outer")
    ahead = F.coalesce(back_fill(F.col("code"), "date"), F.max("code").over(Window.partitionBy()) + 1)  # of a date that is no session: the next one
    dates = stored(dates.select("date", "code", F.col("code").isNotNull().alias("__on"), ahead.alias("__from")), "market-dates")  # a row a day
    stocks = market.agg(F.approx_count_distinct("permno")).first()[0]
    tasks = max(1, -(-stocks * dates.count() // ROWS_A_TASK))
    placed = market.join(F.broadcast(dates.drop("code")), "date").repartition(tasks, "permno")
    following = F.lead("__from").over(Window.partitionBy("permno").orderBy("date"))
    placed = placed.withColumn("__last", F.greatest(following - 1, F.when(F.col("__on"), F.col("__from"))))  # greatest passes over nulls
    filled = placed.withColumn("code", F.explode(F.when(F.col("__last") >= F.col("__from"), F.sequence("__from", "__last"))))
    values = [c for c in market.columns if c not in ("permno", "date")]
    own = F.col("__on") & (F.col("code") == F.col("__from")) & F.col("permno").isNotNull()
    return filled.select("permno", "code", *(F.when(own, F.col(c)).alias(c) for c in values)).join(F.broadcast(dates.where("__on").select("date", "code")), "code")


def controls(market: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The 17 market controls on each stock's own span of the exchange calendar.

    Absent sessions are rows of nulls, so frames never bridge them. A return counts if it is at least
    -1 and the session before has a positive price; strict frames need every value.
    """
    cal = sessions if sessions is not None else session_index(market)
    rows = own_spans(market.select("permno", "date", "ret", "prc", "shrout", "vol"), cal)
    positive = lambda c: F.when(finite(c) > 0, c)
    rows = rows.withColumns({"price": positive(F.abs("prc")), "shares": positive(F.col("shrout")), "volume": F.when(finite(F.col("vol")) >= 0, F.col("vol"))})
    before = F.lag("price").over(Window.partitionBy("permno").orderBy("code"))
    rows = rows.withColumns({"r": F.when((finite(F.col("ret")) >= -1) & before.isNotNull(), F.col("ret")), "dollars": F.col("price") * F.col("volume"), "turnover": F.col("volume") / (1000 * F.col("shares"))})
    rows = rows.withColumn("illiquid", F.abs("r") / F.when(F.col("dollars") > 0, F.col("dollars")))

    rows = with_blocks(rows, ["permno"], "code", 21, most=(F.max, F.col("r")), illiquid=(F.sum, F.col("illiquid")), mean21=(F.avg, F.col("r")), var21=(F.var_pop, F.col("r")))
    rows = with_blocks(rows, ["permno"], "code", 63, mean63=(F.avg, F.col("r")), var63=(F.var_pop, F.col("r")))
    rows = with_running(
        rows, ["permno"], "code",
        illiquid_count=F.when(F.col("illiquid").isNotNull(), 1),
        r_count=F.when(F.col("r").isNotNull(), 1), r_zeros=F.when(F.col("r") == -1, 1), r_logs=F.when(F.col("r") > -1, F.log1p("r")),
        turnover_count=F.when(F.col("turnover").isNotNull(), 1), turnover_sum=F.col("turnover"), dollars_count=F.when(F.col("dollars").isNotNull(), 1), dollars_sum=F.col("dollars"),
    )

    def mean(c: str, h: int) -> Column:
        return F.when(rolled(f"{c}_count", ["permno"], "code", h) == h, rolled(f"{c}_sum", ["permno"], "code", h) / h)

    part = lambda running, h: rolled(running, ["permno"], "code", h)

    def deviation(h: int) -> Column:
        """From means and variances of a block's tail and the next one's head: squares are never summed uncentred."""
        back = lambda c: F.lag(f"{c}{h}_tail", h - 1).over(Window.partitionBy("permno").orderBy("code"))
        own = F.col("code") % h + 1  # rows of the head; the tail has the rest
        apart = back("mean") - F.col(f"mean{h}_head")
        spread = back("var") * (h - own) + F.col(f"var{h}_head") * own + apart * apart * (h - own) * own / h
        return F.when(part("r_count", h) == h, F.sqrt(F.when(own == h, F.col(f"var{h}_head") * h).otherwise(spread) / (h - 1)))

    def of_block(name: str, count: str, join: Callable[[Column, Column], Column]) -> Column:
        return F.when(part(count, 21) == 21, blocked(name, ["permno"], "code", 21, join))

    new = {f"char_ret{h}": _compound(h) for h in CONTROL_RETURNS}
    new |= {
        "momentum": _compound(231),
        "char_log_market_cap": F.log(F.col("price") * F.col("shares") / 1000),
        "char_log_price": F.log("price"),
        "char_turnover1": F.col("turnover"),
        "char_turnover21": mean("turnover", 21),
        "char_log_dollar_volume1": F.log1p("dollars"),
        "char_log_dollar_volume21": F.log1p(mean("dollars", 21)),
        "char_volatility21": deviation(21),
        "char_volatility63": deviation(63),
        "char_max_return21": of_block("most", "r_count", F.greatest),
        "char_amihud21": of_block("illiquid", "illiquid_count", lambda a, b: a + b) / 21,
    }
    out = rows.withColumns(new).withColumn("char_momentum252_skip21", F.lag("momentum", 21).over(Window.partitionBy("permno").orderBy("code")))
    return out.select("permno", "date", *(c for c in sorted({*new, "char_momentum252_skip21"} - {"momentum"})))


def ranked_controls(values: DataFrame) -> DataFrame:
    """Date-local ranks of the controls, missing neutral, with a flag for each that says so."""
    names = [c for c in values.columns if c.startswith("char_")]
    flags = {f"missing__{c}": F.col(c).isNull().cast("int") for c in names}
    return with_ranks(values.select("permno", "date", *(F.col(c).cast("double") for c in names), *(v.alias(c) for c, v in flags.items())), "date", {c: c for c in names})
