"""Packing documents into fixed-length training sequences by hierarchical best fit.

Pieces are dealt out to partitions by hash, and each partition packs its share best-fit, longest first, keeping
bins by what they have left.  Bins so full that none of the others fits in are done; the others go on as items, in
fewer and fewer groups, and are packed best-fit again, until one group is left.  Where rounds stop making them fewer
before that, one last round packs all that are left: as equal sizes are alike, their number for each size is enough to
lay out best fit as a whole, whatever their number, so no merge is lost.  Only the underfull bins travel after the first
round, never the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.bpe import CompiledCodec, read_spec
from wordloom.llm.common import cut, map_rows, pick, shared

CAPACITY = 1024
#: Items that a task packs at once, at most on average.
GROUP = 20_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its bin and its offset there, and each bin's fill; items are taken from the largest down.

    Bins are kept by what they have left, in a bit set that gives the tightest one that still takes an item.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                some &= ~(1 << left)
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left -= size
        if left:
            open_[left].append(b)
            some |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def best_fit_by_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, largest first, of so many items of each size, laid out in segments: size, first, n, each, bin, base.

    Of the items of a size, in any fixed order, the n from number ``first`` on fill bins from number ``bin`` on, ``each`` to
    a bin, from offset ``base``.  Bins alike are kept as runs, so time and room depend on the sizes only.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    out, opened = [], 0
    for size in sorted(counts, reverse=True):
        at, n = 0, counts[size]
        while at < n:
            left = min((x for x, r in runs.items() if r and x >= size), default=None)
            if left is None:
                left = capacity
                runs.setdefault(left, []).append((opened, n - at))
                opened += n - at
            b, k = runs[left].pop()
            each = min(left // size, n - at)
            full = min(k, (n - at) // each)
            out.append((size, at, full * each, each, b, capacity - left))
            at += full * each
            runs.setdefault(left - each * size, []).append((b, full))
            if full < k:
                runs[left].append((b + full, k - full))
    return out


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut only if longer than a sequence.

    The first piece of a cut text may be shorter, all others are full.  A null or empty text is one piece of the end id.
    """
    kept = shared(df, read_spec(tokenizer), CompiledCodec)
    end = np.array([end_id], "<u4").tobytes()

    def start():
        c = kept()

        def f(keys: list, texts: list) -> list[tuple]:
            out = []
            for k, t in zip(keys, texts):
                ids = c.encode_bytes(t or "") + end
                n = len(ids) // 4
                at, length, piece = 0, n % capacity or min(n, capacity), 0
                while at < n:
                    out.append((k, piece, at, length, zlib.crc32(ids[4 * at:4 * (at + length)])))
                    at, length, piece = at + length, capacity, piece + 1
            return out

        return f

    return map_rows(pick(df, key, text), f"doc_id {dict(df.dtypes)[key]}, piece int, start bigint, length bigint, ids_crc32 bigint", start)


def _pack_partition(df: DataFrame, groups: int, key: list[str], size: str, capacity: int) -> DataFrame:
    """Adds bin, at (the offset in it) and used (its fill) to each row, packing the rows of a group together."""
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.LongType()) for n in ("bin", "at", "used")])
    names, sort = df.columns, [(size, "descending"), *[(k, "ascending") for k in key]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by(sort)
        bins, at, fill = best_fit(t.column(size).to_numpy(), capacity)
        ids = bins + (TaskContext.get().partitionId() << 40)
        for name, x in (("bin", ids), ("at", at), ("used", fill[bins])):
            t = t.append_column(name, pa.array(x, pa.int64()))
        yield from t.select([*names, "bin", "at", "used"]).to_batches(max_chunksize=50_000)

    return cut(df.repartition(groups, *key).mapInArrow(run, schema))


def _pack_all(df: DataFrame, capacity: int) -> DataFrame:
    """now_bin, bin and at for rows of now_bin and size, packed as a whole from their number for each size."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            size = b.column(1).to_numpy()
            order = np.argsort(size, kind="stable")
            first = np.r_[True, size[order][1:] != size[order][:-1]] if len(size) else np.zeros(0, bool)
            place = np.arange(len(size))
            nth = np.empty(len(size), np.int64)
            nth[order] = place - np.maximum.accumulate(np.where(first, place, 0)) + met[size[order]]
            met += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(size), part)), pa.array(nth)], names=["now_bin", "size", "part", "nth"])

    numbered = cut(df.mapInArrow(number, "now_bin bigint, size bigint, part bigint, nth bigint"))
    counts = numbered.groupBy("size", "part").count()
    before = F.sum("count").over(W.partitionBy("size").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    ranked = numbered.join(counts.select("size", "part", F.coalesce(before, F.lit(0)).alias("before")), ["size", "part"]).select("now_bin", "size", (F.col("before") + F.col("nth")).alias("rank"))
    plan = np.array(best_fit_by_counts({r[0]: r[1] for r in counts.groupBy("size").agg(F.sum("count")).collect()}, capacity), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] << 48 | plan[:, 1]
        for b in batches:
            size, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
            _, first, _, each, bin_, base = plan[np.searchsorted(keys, size << 48 | rank, side="right") - 1].T
            got = bin_ + (rank - first) // each, base + (rank - first) % each * size
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in got]], names=["now_bin", "bin", "at"])

    return ranked.mapInArrow(place, "now_bin bigint, bin bigint, at bigint")


def pack(items: DataFrame, key: list[str], size: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id (any numbers) and offset (gapless in each sequence) to rows of size 1 to capacity."""
    items = cut(items)
    first = _pack_partition(items, max(1, -(-items.count() // group)), key, size, capacity)
    # bin of the first round -> its bin now, its offset there, and that bin's fill
    now = cut(first.where(F.col("used") < capacity).select(F.col("bin").alias("first_bin"), F.col("bin").alias("now_bin"), F.lit(0).cast("long").alias("base"), "used").distinct())
    level, before = 1, None
    while True:
        open_ = now.select("now_bin", "used").distinct()
        least = open_.agg(F.min("used")).first()[0]
        # Fuller ones take no other bin, now or later.
        open_ = cut(open_.where(F.col("used") <= capacity - (least or 0)).withColumnRenamed("used", "size"))
        n = open_.count()
        if n < 2:
            break
        groups = -(-n // group)
        as_whole = groups > 1 and before is not None and n > 0.99 * before
        if as_whole:
            packed = cut(_pack_all(open_, capacity)).withColumn("used", F.lit(capacity).cast("long"))
        else:
            packed = _pack_partition(open_, groups, ["now_bin"], "size", capacity)
        packed = packed.select("now_bin", (F.col("bin") + F.lit(level << 56)).alias("bin"), "at", F.col("used").alias("filled"))
        now = cut(now.join(packed, "now_bin", "left").select(
            "first_bin", F.coalesce("bin", "now_bin").alias("now_bin"), (F.col("base") + F.coalesce("at", F.lit(0))).alias("base"), F.coalesce("filled", "used").alias("used")
        ))
        if as_whole or groups == 1:
            break
        level, before = level + 1, n
    moved = now.select(F.col("first_bin").alias("bin"), "now_bin", "base")
    out = first.join(moved, "bin", "left")
    return out.select(*items.columns, F.coalesce("now_bin", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row.

    Repeated rows are packed each for itself; an empty table gives no rows.
    """
    return pack(pieces(df, tokenizer, capacity, end_id, key, text), ["doc_id", "piece", "start", "ids_crc32"], "length", capacity)
