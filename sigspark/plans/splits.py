"""Walk-forward splits on a session calendar. A task is a handful of integers, so this is driver arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    """Inclusive session bounds of one test month."""

    month: str
    fit_first: int
    fit_last: int
    valid_first: int
    valid_last: int
    test_first: int
    test_last: int
    horizon: int


def calendar_list(dates: DataFrame) -> list[str]:
    """The session dates, in order; a few hundred a year."""
    return [str(r[0]) for r in dates.select(F.col("date").cast("string")).distinct().orderBy("date").collect()]


def tasks(calendar: Sequence[str], months: Sequence[str], fit: int = 504, valid: int = 126, horizon: int = 1, present: set[int] | None = None) -> list[Task]:
    """Full test months with a fit and a validation block before them.

    With b the session before the month, no label of a block may end after the next one begins:
    validation ends at b - horizon, fitting ``horizon`` sessions before validation begins. A month must
    have neighbours on both sides, so that it is known to be whole; ``present`` lists sessions with data.
    """
    if min(fit, valid, horizon) < 1:
        raise ValueError("windows and horizon must be positive")
    if len(set(months)) != len(months):
        raise ValueError("a test month is asked for twice")
    out = []
    for month in sorted(months):
        inside = [i for i, d in enumerate(calendar) if d[:7] == month]
        if not inside or inside[0] == 0 or inside[-1] == len(calendar) - 1:
            raise ValueError(f"the calendar does not hold all of {month} and its neighbours")
        valid_last = inside[0] - 1 - horizon
        valid_first = valid_last - valid + 1
        fit_last = valid_first - 1 - horizon
        task = Task(month, fit_last - fit + 1, fit_last, valid_first, valid_last, inside[0], inside[-1], horizon)
        if task.fit_first < 0:
            raise ValueError(f"not enough sessions before {month}")
        for block in ("fit", "valid", "test"):
            low, high = getattr(task, f"{block}_first"), getattr(task, f"{block}_last")
            if present is not None and (absent := [calendar[i] for i in range(low, high + 1) if i not in present]):
                raise ValueError(f"{month}: no {block} data on {absent[:5]}")
        out.append(task)
    return out


def legacy_windows(dates: Sequence[str], months: Sequence[str], window: int = 252) -> list[tuple[str, str, str]]:
    """(month, first, last): the last ``window`` dates up to two calendar days before the month begins.

    A month counts only with window + 1 dates before that cutoff.
    """
    from datetime import date, timedelta

    out = []
    for month in sorted(months):
        cutoff = str(date.fromisoformat(f"{month}-01") - timedelta(days=2))
        before = [d for d in sorted(dates) if d <= cutoff]
        if len(before) > window:
            out.append((month, before[-window], before[-1]))
    return out


def as_frame(spark: SparkSession, found: Sequence[Task]) -> DataFrame:
    return spark.createDataFrame([asdict(t) for t in found], "month string, fit_first int, fit_last int, valid_first int, valid_last int, test_first int, test_last int, horizon int")


def blocks(panel: DataFrame, task_frame: DataFrame) -> DataFrame:
    """Panel rows of every block of every task. A row joins the sessions of the blocks that hold it:
    an equality join on the session, with the small task side sent out."""
    listed = None
    for block in ("fit", "valid", "test"):
        part = task_frame.select("month", F.lit(block).alias("block"), F.explode(F.sequence(f"{block}_first", f"{block}_last")).alias("code"))
        listed = part if listed is None else listed.unionByName(part)
    return panel.join(F.broadcast(listed), "code")
