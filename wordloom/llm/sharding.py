"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is the rows of one key, by default of one text.  Groups are sorted by size, and each enters the shard with
the tightest remaining capacity that still takes it, found in a balanced tree of remaining capacities; a new shard
opens where none does, or, with a fixed number of shards, the emptiest one takes it.

The packing is hierarchical, so that it stays bounded however many groups there are.  Groups are dealt out by hash, and
each task packs its share best-fit decreasing into bins of 1/FINE of a shard (a larger group has a bin of its
own).  Those bins, whole, are the items of the next level; all but one of a task's are more than half full, so at most
2 FINE bins for each shard and one for each task are left.  When they are few enough for one place, they are packed
best-fit decreasing into the shards.
A group larger than a whole shard can't stay in one while shards are of near equal size: only such a group is split, by a
hash of the row's key, into parts that the packing takes as groups.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.llm.common import cut, pick

#: Bins of all levels but the last are of 1/FINE of a shard; parts of a split group are of that order as well.
FINE = 512
#: Groups or bins that a task packs, about, and bins that the last level packs in one place, at most.
ITEMS, LAST = 20_000, 50_000
#: Rows that one task numbers, about.
NUMBERED = 20_000


class Remaining:
    """(remaining, bin) pairs in order: a balanced tree of two levels, whose leaves split when they are full."""

    def __init__(self, leaf: int = 512) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.least: list[tuple[int, int]] = [(-1, -1)]
        self.leaf = leaf

    def add(self, left: int, b: int) -> None:
        i = max(0, bisect_left(self.least, (left, b)) - 1)
        insort(self.leaves[i], (left, b))
        if len(self.leaves[i]) > self.leaf:
            half = len(self.leaves[i]) // 2
            self.leaves.insert(i + 1, self.leaves[i][half:])
            del self.leaves[i][half:]
            self.least.insert(i + 1, self.leaves[i + 1][0])

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the pair with the least remaining capacity that takes size."""
        i = max(0, bisect_left(self.least, (size, -1)) - 1)
        while i < len(self.leaves):
            at = bisect_left(self.leaves[i], (size, -1))
            if at < len(self.leaves[i]):
                got = self.leaves[i].pop(at)
                if not self.leaves[i] and i:
                    del self.leaves[i], self.least[i]
                return got
            i += 1
        return None

    def most(self) -> tuple[int, int]:
        """Removes and returns the pair with the most remaining capacity, the first bin of those alike."""
        top = next(x for x in reversed(self.leaves) if x)[-1][0]
        return self.take(top)


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int | None = None) -> list[int]:
    """The bin of each item.  With ``bins`` given, an item that no bin takes enters the emptiest one, over its capacity."""
    tree, out, opened = Remaining(), [0] * len(sizes), bins or 0
    for b in range(opened):
        tree.add(capacity, b)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.take(sizes[i])
        if got is None and bins:
            got = tree.most()
        elif got is None:
            got, opened = (max(capacity, sizes[i]), opened), opened + 1
        tree.add(got[0] - sizes[i], got[1])
        out[i] = got[1]
    return out


def _pack_local(items: DataFrame, capacity: int, level: int, per_task: int) -> DataFrame:
    """unit, bin and bytes (the bin's fill) for each unit and size; each task packs its share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("size", "descending"), ("unit", "ascending")])
        sizes = t.column("size").to_numpy()
        bins = np.array(best_fit_decreasing(sizes.tolist(), capacity), np.int64)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        t = t.select(["unit"]).append_column("bin", pa.array(bins + (level << 56 | TaskContext.get().partitionId() << 32))).append_column("bytes", pa.array(fill[bins]))
        yield from t.to_batches(max_chunksize=50_000)

    return cut(items.repartition(max(1, -(-items.count() // per_task)), "unit").mapInArrow(run, f"unit {dict(items.dtypes)['unit']}, bin bigint, bytes bigint"))


def assign_shards(rows: DataFrame, shards: int | None = None, capacity: int | None = None, per_task: int = ITEMS, last: int = LAST) -> DataFrame:
    """rows: doc_id, h (the group) and size, with any others.  Adds shard.

    Either a number of shards of near equal size is given, or a capacity, and the number of shards is kept low.
    ``per_task`` and ``last`` bound what one task and the last level pack.
    """
    spark = rows.sparkSession
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    capacity = capacity or max(1, -(-total // (shards or 1)))
    grain = max(1, capacity // FINE)
    # As many groups as there are shards, at most, are larger than one.
    large = [(bytes(r.h), int(-(-r.bytes // grain))) for r in groups.where(F.col("bytes") > capacity).collect()]
    table = F.broadcast(spark.createDataFrame(large, "h binary, parts int"))
    part = F.concat("h", F.lit(b"/"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("string").cast("binary"))
    placed = rows.join(table, "h", "left").withColumn("unit", F.when(F.col("parts").isNull(), F.col("h")).otherwise(part)).drop("parts")
    items = groups.join(table, "h", "left_anti").select(F.col("h").alias("unit"), F.col("bytes").alias("size"))
    if large:
        items = items.union(placed.join(table, "h", "left_semi").groupBy("unit").agg(F.sum("size").alias("size")))
    first = _pack_local(items, grain, 0, per_task)
    now, level, chain = first.select(F.col("bin").alias("unit"), F.col("bytes").alias("size")).distinct(), 1, first.select("unit", "bin")
    last = max(last, 3 * (shards or 0))
    while now.count() > last and (grain < capacity or level == 1):
        grain = min(capacity, 4 * grain)
        more = _pack_local(now, grain, level, per_task)
        chain = chain.join(more.select("unit", "bin").toDF("bin", "next"), "bin").select("unit", F.col("next").alias("bin"))
        now, level = more.select(F.col("bin").alias("unit"), F.col("bytes").alias("size")).distinct(), level + 1
    if now.count() > last:
        # More shards than one place holds, all but one of a task's more than half full: they stay as they are.
        numbered = with_slots(now.select("unit", "size", F.lit(0).alias("shard")), ["unit"])
        found = numbered.select(F.col("unit").alias("bin"), F.col("slot").cast("int").alias("shard"))
    else:
        top = sorted((r.unit, r.size) for r in now.collect())
        bins = best_fit_decreasing([x for _, x in top], capacity, shards)
        # ``last`` rows at most.
        found = F.broadcast(spark.createDataFrame([(u, b) for (u, _), b in zip(top, bins)], "bin bigint, shard int"))
    return placed.join(chain.join(found, "bin").select("unit", "shard"), "unit").drop("unit")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds slot, gapless from 0 in each shard.

    Rows are numbered inside hashed sections of a shard, about NUMBERED rows each; a section starts where the
    ones before it end, so no task numbers a whole shard.
    """
    shards = max(1, rows.select("shard").distinct().count())
    sections = max(16, -(-rows.count() // (shards * NUMBERED)))
    rows = rows.withColumn("section", F.pmod(F.xxhash64(*order), F.lit(sections)).cast("int"))
    counts = rows.groupBy("shard", "section").count()
    before = F.sum("count").over(W.partitionBy("shard").orderBy("section").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "section", F.coalesce(before, F.lit(0)).alias("begins"))
    place = F.row_number().over(W.partitionBy("shard", "section").orderBy(*order))
    numbered = rows.withColumn("place", place)
    return numbered.join(starts, ["shard", "section"]).withColumn("slot", F.col("begins") + F.col("place") - 1).drop("section", "place", "begins")


def shard_documents(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row.

    The law is ``bytes``.  Null text counts as empty and is of size 1.  Equal texts stay together unless they alone
    exceed a shard.  Repeated rows each have a slot; an empty table gives no rows; grown_shard is null.
    """
    rows = pick(df, key, text).toDF("doc_id", "raw").select("doc_id", F.coalesce("raw", F.lit("")).alias("raw"))
    rows = cut(rows.select("doc_id", F.unhex(F.md5("raw")).alias("h"), (F.octet_length("raw") + 1).cast("long").alias("size"), F.crc32(F.col("raw").cast("binary")).alias("text_crc32")))
    placed = cut(assign_shards(rows, shards).drop("h"))
    done = with_slots(placed, ["doc_id", "size", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
