"""9. Mixing sources to target weights by weighted fair queueing.

Every source is a flow whose weight is its target; its documents, shuffled anew for each repeat, are
served one after the other. A turn (one repeat of one document) has a virtual finish time: the words its
source has served up to and with it, divided by the source's target. All turns are range-sorted by that
time and the order is cut where its words reach the total budget.

Both running sums, within a source and over all turns, are taken in two steps: sums of buckets or of sorted
parts, then a window inside each. Buckets come from hashes of a document's id, text and number among its
equals, so that a source, an id or a group of equal rows with a third of all rows is as many buckets as it
needs; no sum depends on how Spark cuts partitions, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import free_name, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BUCKET = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source_size, n_docs and target.

    Weights go round the sources in code-point order, null last. A target stops at ``repeats`` times
    its source's size and the excess is shared again by weight. Filling sources in the order of
    cap / weight gives the same limit in one pass: a source is full when its share of what is left
    after the fuller ones reaches its cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    left = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    levels = capped.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # fullness holds up to some place in this order; from there on all share that place's level
    first_level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * first_level)
    return levels.select("source", "source_size", "n_docs", F.round(target, 6).alias("target"))


KEYS = ("id", "source", "digest")  # rows equal in these are told apart by number
ORDER = ("time", "id", "digest", "nth", "repeat")


def _before(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, from 1 among rows of equal ``KEYS``: a number inside each written part, after those of the parts before it."""
    parted = rows.withColumns({"key": F.xxhash64(*KEYS), "split": F.shiftright("row", 33)})
    counts = parted.groupBy("key", "split").agg(F.count("*").alias("n"))
    offsets = counts.select(F.col("key").alias("o_key"), F.col("split").alias("o_split"), F.coalesce(F.sum("n").over(_before(["key"], "split")), F.lit(0)).alias("offset"))
    inside = parted.withColumn("nth", F.row_number().over(Window.partitionBy("key", "split").orderBy("row")))
    joined = inside.join(offsets, (F.col("key") == F.col("o_key")) & (F.col("split") == F.col("o_split")))
    return joined.withColumn("nth", F.col("nth") + F.col("offset")).drop("key", "split", "o_key", "o_split", "offset")


def _place(seed: str) -> Column:
    """A document's place in [0, 1) in the shuffled order of one repeat."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), *map(text, ("repeat", "id", "digest", "nth"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def finish_times(rows: DataFrame, repeats: int, seed: str, bucket: int = BUCKET) -> DataFrame:
    """A row for each repeat of each of ``rows``, with its virtual finish ``time``; none for targets of zero."""
    turns = rows.where("target > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    placed = turns.withColumn("place", _place(seed)).withColumn("bucket", F.floor(F.col("place") * F.ceil(F.col("n_docs") / bucket)))
    keys = ["source", "repeat", "bucket"]
    sums = placed.groupBy(*keys).agg(F.sum("size").alias("words"))
    offsets = sums.select(*(F.col(c).alias(f"o_{c}") for c in keys), F.coalesce(F.sum("words").over(_before(keys[:2], "bucket")), F.lit(0)).alias("offset"))
    inside = F.sum("size").over(Window.partitionBy(*keys).orderBy("place", "id", "digest", "nth").rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("inside", inside).join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("repeat") == F.col("o_repeat")) & (F.col("bucket") == F.col("o_bucket")))
    served = F.col("repeat") * F.col("source_size") + F.col("offset") + F.col("inside")
    return joined.select("row", "id", "digest", "nth", "repeat", "size", (served / F.col("target")).alias("time"))


def taken_turns(turns: DataFrame, budget: float) -> DataFrame:
    """row, repeat, size and turn (place in the mix, from 1) of the turns that stand before the order's words exceed ``budget``."""
    ordered = turns.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "mix-order")
    sums = ordered.groupBy("part").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    offsets = sums.select(F.col("part").alias("o_part"), *(F.coalesce(F.sum(c).over(_before([], "part")), F.lit(0)).alias(f"o_{c}") for c in ("words", "n")))
    running = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.withColumns({"words": F.sum("size").over(running), "turn": F.row_number().over(running)}).join(offsets, F.col("part") == F.col("o_part"))
    upto = F.col("o_words") + F.col("words")
    return placed.where(upto <= budget).select("row", "repeat", "size", (F.col("o_n") + F.col("turn")).alias("turn"))


def _plan(rows: DataFrame, weights: Sequence[float], share: float, repeats: int, seed: str, bucket: int) -> tuple[DataFrame, DataFrame]:
    """All rows (row, id, source, size, digest) with their source's figures, and the turns that the mix takes."""
    sizes = materialize(_numbered(rows), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, repeats), "mix-targets")
    facts = targets.select(F.col("source").alias("t_source"), "source_size", "n_docs", "target")
    known = sizes.join(facts, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    budget = targets.agg(F.round(F.sum("target"), 3)).first()[0] or 0.0
    return known, materialize(taken_turns(finish_times(known, repeats, seed, bucket), budget), "mix-turns")


def _measured(docs: DataFrame, row: str, id_col: str, text: str, source: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"))


def schedule(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix", bucket: int = BUCKET) -> DataFrame:
    """For every row of ``docs``: its id, source, size, source_size, target, takes (0 to ``repeats``) and taken (words, repeats counted).

    Size is the number of words, zero for null or empty texts. Null is a source of its own, the last.
    Rows with equal or null ids are documents of their own, equal rows are interchangeable; ties in time go by
    id, text digest and number. Very long texts are measured whole. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    row = free_name(docs, "row")
    rows = materialize(_measured(docs.withColumn(row, F.monotonically_increasing_id()), row, id_col, text, source), "mix-rows")
    known, turns = _plan(rows, weights, share, repeats, seed, bucket)
    takes = turns.groupBy(F.col("row").alias("t_row")).agg(F.count("*").alias("takes"))
    n = F.coalesce("takes", F.lit(0))
    return known.join(takes, F.col("row") == F.col("t_row"), "left").select(F.col("id").alias(id_col), F.col("source").alias("source"), "size", "source_size", "target", n.alias("takes"), (n * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix", bucket: int = BUCKET) -> DataFrame:
    """``docs`` in the order of the mix: one row for each turn that ``schedule`` takes, at its own virtual finish time, sorted over all partitions.

    Columns are those of ``docs``, whatever their names; null, empty, repeated and very long texts are treated as
    in ``schedule``; an empty table gives an empty result. Rows are numbered in a written copy of ``docs``, as a
    second scan of the same files may be cut otherwise (after executors are lost, say); so rows with equal
    ids need no key, and a text moves once to its turns and once to their places.
    """
    row = free_name(docs, "row")
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs", compression="zstd")
    _, turns = _plan(_measured(kept, row, id_col, text, source), weights, share, repeats, seed, bucket)
    to, at = free_name(docs, "turn_row"), free_name(docs, "turn")
    return kept.join(turns.select(F.col("row").alias(to), F.col("turn").alias(at)), F.col(row) == F.col(to)).orderBy(at).select(*docs.columns)
