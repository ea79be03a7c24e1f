"""Complete (entity, session) grids and rolling frames on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def session_index(dates: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with a running number ``code``: the calendar as the market data have it."""
    return dates.select(date).where(F.col(date).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(date)) - 1)


def complete(entities: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every entity on every session. The calendar has a few hundred rows a year, whatever the data, so it is replicated."""
    return entities.crossJoin(F.broadcast(sessions))


def fill_grid(grid: DataFrame, facts: DataFrame, keys: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """Facts on the grid; silent days have zero in the ``zero`` columns and null in the others."""
    return grid.join(facts, list(keys), "left").withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(facts.schema[c].dataType)) for c in zero})


def frame(by: Sequence[str], order: str, rows: int) -> WindowSpec:
    """The current row and the rows - 1 before it."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)


def strict(value: Column, counted: Column, over: WindowSpec, rows: int) -> Column:
    """A rolling value, null unless all ``rows`` of its frame are present."""
    return F.when(F.count(counted).over(over) == rows, value.over(over))


def with_running(df: DataFrame, by: Sequence[str], order: str, **sums: Column) -> DataFrame:
    """Adds running sums under the given names; missing values add nothing.

    A bounded frame is summed anew at every row, so long frames cost their length; the difference of two
    running sums costs the same whatever the frame. Whole numbers stay exact.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.coalesce(F.sum(c).over(w), F.lit(0)) for name, c in sums.items()})


def rolled(running: str, by: Sequence[str], order: str, rows: int) -> Column:
    """The sum over the current row and the rows - 1 before it, from a running sum."""
    return F.col(running) - F.coalesce(F.lag(running, rows).over(Window.partitionBy(*by).orderBy(order)), F.lit(0))


def with_blocks(df: DataFrame, by: Sequence[str], code: str, rows: int, **values: tuple[Callable[[str], Column], Column]) -> DataFrame:
    """Adds name_head and name_tail: a fold of each value from the start of its block of ``rows`` codes, and to its end.

    Codes must be without gaps. A frame of ``rows`` rows is a tail of one block and a head of the next, so any fold (sums,
    extremes) costs two steps a row whatever the frame, and sums lose no digits to what lies outside of it.
    """
    block = Window.partitionBy(*by, F.floor(F.col(code) / rows))
    df = df.withColumns({f"{n}_in": v for n, (_, v) in values.items()})
    for side, order in (("head", F.asc(code)), ("tail", F.desc(code))):
        over = block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"{n}_{side}": fold(f"{n}_in").over(over) for n, (fold, _) in values.items()})
    return df.drop(*(f"{n}_in" for n in values))


def blocked(name: str, by: Sequence[str], code: str, rows: int, join: Callable[[Column, Column], Column]) -> Column:
    """The fold over the current row and the rows - 1 before it, from a head and a tail; missing ones do not count."""
    tail, head = F.lag(f"{name}_tail", rows - 1).over(Window.partitionBy(*by).orderBy(code)), F.col(f"{name}_head")
    whole = F.col(code) % rows == rows - 1  # the frame is a block
    return F.when(whole, head).when(tail.isNull(), head).when(head.isNull(), tail).otherwise(join(tail, head))


def adjacent(value: Column, by: Sequence[str], code: str, step: int = 1) -> Column:
    """The value one session before (step 1) or after (-1); null if the neighbouring row is another session."""
    w = Window.partitionBy(*by).orderBy(code)
    return F.when(F.lag(code, step).over(w) == F.col(code) - step, F.lag(value, step).over(w))


def back_fill(value: Column, order: str, by: Sequence[str] = ()) -> Column:
    """The first value at or after each row."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing))


def rolling_mean_min(value: str, by: Sequence[str], order: str, rows: int, least: int) -> Column:
    w = frame(by, order, rows)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def shifted_on_calendar(series: DataFrame, calendar: DataFrame, value: str, by: Sequence[str] = (), step: int = 1) -> DataFrame:
    """Put a series on the calendar and shift it by sessions."""
    grid = calendar.select("date") if not by else complete(series.select(*by).distinct(), calendar.select("date"))
    w = Window.partitionBy(*by).orderBy("date")
    return grid.join(series, [*by, "date"], "left").withColumn(value, F.lag(value, step).over(w))
