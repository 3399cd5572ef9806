"""Relational building blocks that many operators share; every ranking has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group (WIN-02, WIN-04..07, WIN-10, WIN-13, SRT-01..09).

    Spark pushes the limit below the shuffle (WindowGroupLimit), so a large group sends k rows from each task.
    """
    out = df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order (WIN-12, SRC-21, SRC-22, SET-01, SET-07, FLT-32)."""
    return top_k(df, by, order, 1)


def latest(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The last writer wins (USR-01, USR-10, VAR-34)."""
    return first_by(df, by, [F.desc(c) for c in order])


def global_rank(df: DataFrame, order: list[Column], name: str = "freq_rank", run: int = 4096) -> DataFrame:
    """1, 2, 3, ... in order over the whole table (WIN-01, VAR-04).

    Not one window over one partition: rows are range-partitioned and sorted, each task counts its rows, and a
    small table of the tasks' counts tells where each begins.
    """
    from wordloom.operators.tables import cut

    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    # The id's upper bits are the task, its lower 33 bits the place there.
    task, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(task.alias("_task")).count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("_task", before.alias("_begins"))
    return sorted_.withColumn("_task", task).join(begins, "_task").withColumn(name, F.col("_begins") + place + 1).drop("_id", "_task", "_begins")


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """0, 1, 2, ... in order within each group, as ``global_rank``: a group of any size is split over tasks."""
    from wordloom.operators.tables import cut

    keys = [*[F.asc(c) for c in by], *order]
    sorted_ = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_id", 33))
    # A row for each task and group; groups of one task have one.
    counts = sorted_.groupBy(*by, "_task").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sorted_.join(counts.select(*by, "_task", (before - F.col("_first")).alias("_shift")), [*by, "_task"]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_task", "_shift")


def running_budget(df: DataFrame, by: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """WIN-08, WIN-09: adds ``taken``, how much of a row's cost the group's budget still covers in order; uncovered rows go."""
    before = F.coalesce(F.sum(cost).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(budget) - before)
    return df.withColumn("taken", F.least(F.col(cost), left)).where("taken > 0")


def runs(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """AGG-26: adds ``run``, the number of the row's stretch of equal neighbouring values."""
    w = W.partitionBy(*by).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def neighbours(df: DataFrame, by: list[str], order: list[Column], value: str, k: int = 6) -> DataFrame:
    """WIN-10: adds ``before`` and ``after``, up to k values on either side in order."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("before", F.collect_list(value).over(w.rowsBetween(-k, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, k)))


def balanced_pick(df: DataFrame, by: list[str], family: str, order: list[Column], k: int, share: float = 0.6) -> DataFrame:
    """WIN-03: k rows a group, at most ceil(share * k) of one family as long as others are there, in rank ``picked``.

    Rows within their family's allowance come first, then the rest, both in order.  Texts are unique in a group.
    """
    allowance = -(-int(k * share * 1000) // 1000)
    inside = F.row_number().over(W.partitionBy(*by, family).orderBy(*order))
    ranked = df.withColumn("_over", (inside > allowance).cast("int"))
    return top_k(ranked, by, [F.col("_over"), *order], k, "picked").drop("_over")


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """WIN-15: n rows, one from each group in turn."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_turn", turn).where(F.col("_turn") <= n).orderBy("_turn", group).limit(n).drop("_turn")


def bottom_k_sample(df: DataFrame, by: list[str], draw: Column, tie: list[Column], k: int) -> DataFrame:
    """SRT-10..12: k rows a group by a value-based draw: the same rows whatever the order and the partitions."""
    return top_k(df.withColumn("_draw", draw), by, [F.col("_draw"), *tie], k).drop("_draw")


def first_not_null(df: DataFrame, by: list[str], order: list[Column], *columns: str) -> DataFrame:
    """AGG-23, AGG-24: each column's first value that isn't null, in order."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    placed = df.withColumn("_place", place)
    return placed.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_place"))).alias(c) for c in columns])


def set_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """SET-04, VAR-46."""
    return a.join(b, on, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-11: rows of one side that the other lacks, with their side; rows count with their multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
