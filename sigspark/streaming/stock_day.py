"""Stock-day sentiment and attention over a stream of messages.

The same routing as in batch; days are closed by a watermark on the message time, so late messages
within it count and later ones are dropped. State is one row of counts for each open (symbol, date).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import ratio
from ..plans.messages import per_symbol, route, tagged, with_time_parts


def daily_sentiment(messages: DataFrame, closes: DataFrame, lateness: str = "2 days") -> DataFrame:
    """symbol, date, n_bullish, n_bearish, net_sentiment from a stream with ``created_at`` as event time.

    In append mode a message day is emitted when the watermark has passed it. A trading date gathers the
    days routed to it (a weekend's and the Monday's), so the group has the message's local day as well.
    """
    timed = with_time_parts(tagged(messages.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)))
    rows = per_symbol(route(timed, closes))
    counts = rows.groupBy("symbol", "date", F.window("created_at", "1 day").alias("day")).agg(F.count_if(F.col("sentiment") == "Bullish").alias("n_bullish"), F.count_if(F.col("sentiment") == "Bearish").alias("n_bearish"))
    total = F.col("n_bullish") + F.col("n_bearish")
    return counts.select("symbol", "date", F.col("day.start").alias("day"), "n_bullish", "n_bearish", ratio(F.col("n_bullish") - F.col("n_bearish"), total).alias("net_sentiment"))


def user_flips(rows: DataFrame) -> DataFrame:
    """Direction changes of each user on each symbol as they happen; state is the last direction and time.

    ``rows``: user_id, symbol, created_at, sentiment. Rows of one micro-batch are put in time order; a row
    older than the state is counted as of its own time but does not set the state back.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (0, pd.Timestamp.min.value)
        out = []
        for r in pd.concat(list(batches)).sort_values(["created_at", "sentiment"]).itertuples():
            direction, now = (1 if r.sentiment == "Bullish" else -1), r.created_at.value
            if now < at:
                continue
            if last and direction != last:
                out.append((key[0], key[1], r.created_at, direction))
            last, at = direction, now
        state.update((last, at))
        yield pd.DataFrame(out, columns=["user_id", "symbol", "created_at", "direction"])

    return rows.groupBy("user_id", "symbol").applyInPandasWithState(update, "user_id long, symbol string, created_at timestamp, direction int", "direction int, at long", "append", GroupStateTimeout.NoTimeout)
