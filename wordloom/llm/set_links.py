"""Classes of similar sets: pairs that share a key are compared by the Jaccard index of their whole sets.

In each key that several sets share, every set is paired with the key's first one, or with the first of its run that is paired
with that, and a distributed union-find joins those that are similar.  Keys that then still hold several classes hold pairs that were never compared: their
sets are compared with all sets of other classes, in blocks of bounded size.  So no link among the sets of a key is
lost, a key's pairs are never emitted, and copies that are linked already cost nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Tables, tidy, trim
from wordloom.llm.components import connected_components

#: Sets of a key that one task compares at once.
BLOCK = 1000
#: Records of keys and ids that a task sorts at once.
RUN = 1 << 20
#: Members of a key whose pairs are all taken at once.
FEW = 24
#: From a batch of rows: keys, as unsigned numbers whose upper bits are even, and ids.
Expand = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
#: From data of some sets and their keys' kind: the sets' sizes and, one after the other, their sorted distinct values.
Sets = Callable[[list, int], tuple[np.ndarray, np.ndarray]]
#: Bits of a value that count where many pairs are compared at once; larger sets than MANY are compared one by one, in full.
BITS, MANY = np.uint64(42), 4096


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values; 1 for two empty ones."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0 if len(b) else 1.0
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several runs, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)


def pair_jaccards(sizes: np.ndarray, values: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """The Jaccard index of the sets i and j of each pair; 0 where their sizes alone keep it below the threshold."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    out = np.zeros(len(i))
    low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    near = low >= threshold * high
    for p in np.flatnonzero(near & ((high > MANY) | (low == 0))):
        out[p] = jaccard(*[values[starts[x]:starts[x] + sizes[x]] for x in (i[p], j[p])])
    some = np.flatnonzero(near & (high <= MANY) & (low > 0))
    if len(some):
        either = np.r_[i[some], j[some]]
        pair = np.repeat(np.r_[np.arange(len(some)), np.arange(len(some))], sizes[either]).astype(np.uint64)
        x = (pair << BITS) | (values[_slices(starts[either], sizes[either])] >> (np.uint64(64) - BITS))
        x.sort()
        both = np.bincount((x[1:][x[1:] == x[:-1]] >> BITS).astype(np.int64), minlength=len(some))
        out[some] = both / (sizes[i[some]] + sizes[j[some]] - both)
    return out


def _members(rows: DataFrame, expand: Expand, per_row: int) -> DataFrame:
    """key, rep (the key's smallest id, or one that stands for it) and id, for all other ids of keys that several share.

    Each task sorts a run of its keys and joins ids of a key to the run's smallest, which alone goes on to the key's task.  So
    a key that very many share sends one record a run, and no task holds more than runs of bounded size and its share of distinct keys.
    Records travel packed, for each range of keys one binary row a run.
    """
    bits = max(2, (max(1, rows.count() * per_row // RUN) - 1).bit_length())
    parts = 1 << bits

    def grouped(key: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct keys and their smallest ids, and key, smallest id and id for all others."""
        order = np.argsort(key)
        key, id_ = key[order], id_[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.minimum.reduceat(id_, first)
        rep = np.repeat(least, np.diff(np.r_[first, len(key)]))
        more = id_ != rep
        return key[first], least, key[more], rep[more], id_[more]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        turn = TaskContext.get().partitionId()

        def packed() -> Iterator[pa.RecordBatch]:
            head, least, key, rep, id_ = grouped(*(np.concatenate(x) for x in zip(*held)))
            cuts = np.searchsorted(head, np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - bits))
            out = [(p, k.tobytes(), i.tobytes(), b"") for p, (k, i) in enumerate(zip(np.split(head, cuts), np.split(least, cuts))) if len(k)]
            # Settled records pass through any task.
            if len(key):
                out.append((parts + turn % parts, key.tobytes(), rep.tobytes(), id_.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "keys", "reps", "ids"])

        for b in batches:
            if b.num_rows:
                held.append(expand(b))
            if sum(len(x[0]) for x in held) >= RUN:
                yield from packed()
                held.clear()
                turn += 1
        if sum(len(x[0]) for x in held):
            yield from packed()
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def rows_of(key: np.ndarray, rep: np.ndarray, id_: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k:k + 50_000]) for x in (key.view(np.int64), rep, id_)], names=["key", "rep", "id"])

        for b in batches:
            for part, *blobs in zip(*[c.to_pylist() for c in b.columns]):
                key, rep, id_ = (np.frombuffer(x, t) for x, t in zip(blobs, (np.uint64, np.int64, np.int64)))
                if part >= parts:
                    yield from rows_of(key, rep, id_)
                    continue
                if part != at and held:
                    yield from rows_of(*grouped(*(np.concatenate(x) for x in zip(*held)))[2:])
                    held.clear()
                at = part
                held.append((key, rep))
        if held:
            yield from rows_of(*grouped(*(np.concatenate(x) for x in zip(*held)))[2:])
        trim()

    runs = rows.mapInArrow(combine, "part int, keys binary, reps binary, ids binary")
    return runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "key bigint, rep bigint, id bigint")


def set_classes(rows: DataFrame, expand: Expand, per_row: int, source: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], sets: Sets, threshold: float, kinds: bool = False, met: Callable[[], None] = lambda: None) -> DataFrame:
    """node and root (the smallest id of the class) for each id that isn't a root.

    expand makes keys and ids of a batch of rows, about ``per_row`` of each.  source gets a frame of all ids whose data will be
    asked for, and returns what adds a column data to a frame with a column id; sets makes sets of data.  With ``kinds`` the
    lowest bit of a key is the kind of set that its ids are compared by, else it is 0.  ``met`` is called when rows are no longer needed.
    """
    kind = F.col("key").bitwiseAND(F.lit(1)).cast("int") if kinds else F.lit(0)
    with Tables(rows.sparkSession) as tables:
        members = tables.keep(_members(rows, expand, per_row))
        met()
        tidy(rows)
        pairs = tables.keep(members.select("rep", "id", kind.alias("kind")).distinct())
        with_data = source(pairs.select("id").union(pairs.select("rep")).distinct())
        tidy(rows)
        roots = connected_components(_verified(pairs, with_data, sets, threshold))
        tidy(rows)
        open_ = tables.keep(_open_members(members.withColumn("kind", kind), roots))
        if not open_.isEmpty():
            roots = connected_components(roots.toDF("a", "b").union(_rest(open_, with_data, sets, threshold)))
        return roots


def _verified(pairs: DataFrame, with_data: Callable[[DataFrame], DataFrame], sets: Sets, threshold: float) -> DataFrame:
    """Links between a rep and its ids: rows of a rep come together, itself first.

    A rep has as many ids as a run has records at most, or as there are runs.
    """
    asked = pairs.select("rep", "kind", "id").unionByName(pairs.select("rep", "kind", F.col("rep").alias("id")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            k = 0
            while k < batch.num_rows:
                n = min(1000, batch.num_rows - k)
                while n > 1 and batch.slice(k, n).nbytes > 1 << 20:
                    n //= 2
                rows = list(zip(*[c.to_pylist() for c in batch.slice(k, n).select(["rep", "kind", "id", "data"]).columns]))
                k += n
                todo: dict[int, tuple[dict, list, list, list]] = {}
                for rep, kind, id_, data in rows:
                    if (rep, kind) != at:
                        # Its first row is the rep's own.
                        at, head = (rep, kind), data
                    if id_ != rep:
                        place, i, j, found = todo.setdefault(kind, ({}, [], [], []))
                        i.append(place.setdefault(head, len(place)))
                        j.append(place.setdefault(data, len(place)))
                        found.append((rep, id_))
                for kind, (place, i, j, links) in todo.items():
                    near = np.flatnonzero(pair_jaccards(*sets(list(place), kind), np.array(i), np.array(j), threshold) >= threshold)
                    if len(near):
                        a, b = zip(*[links[n] for n in near.tolist()])
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        trim()

    rows = with_data(asked).withColumn("other", F.col("id") != F.col("rep")).repartition("rep", "kind").sortWithinPartitions("rep", "kind", "other")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The ids of keys that are of several classes still; columns key, kind, id, root and size.

    A key's only rep was compared with all its ids, so it isn't one of them; where a key has several reps, all its ids are.
    """
    reps = members.select("key", "kind", F.col("rep").alias("id"), F.lit(None).cast("bigint").alias("rep")).distinct()
    every = members.select("key", "kind", "id", "rep").union(reps)
    rooted = every.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "kind", "id", "rep", F.coalesce("root", "id").alias("root"))
    own = lambda c: F.when(F.col("rep").isNotNull(), c)
    sums = rooted.groupBy("key").agg(
        (F.min("rep") == F.max("rep")).alias("star"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"),
        F.min(own(F.col("root"))).alias("own_low"), F.max(own(F.col("root"))).alias("own_high"), F.count("rep").alias("own_size"),
    )
    several = sums.where("if(star, own_low < own_high, low < high)").select("key", "star", F.expr("if(star, own_size, size)").alias("size"))
    return rooted.join(several, "key").where("NOT star OR rep IS NOT NULL").select("key", "kind", "id", "root", "size")


def _rest(open_: DataFrame, with_data: Callable[[DataFrame], DataFrame], sets: Sets, threshold: float) -> DataFrame:
    """Links among the members of a key that are of several classes; columns key, kind, id, root and size."""
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), chunks).cast("int")
    parts = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.least(j, mine) * chunks + F.greatest(j, mine))
    rows = with_data(open_).select("key", F.explode(parts).alias("part"), "kind", "id", "root", "data")

    def small(kind: int, groups: list[list[tuple]]) -> list[tuple]:
        """Links of groups with few members, all pairs of different classes at once."""
        members = [x for g in groups for x in g]
        sizes, values = sets([x[2] for x in members], kind)
        ids, roots_ = (np.array([x[k] for x in members], np.int64) for k in (0, 1))
        many = np.array([len(g) for g in groups])
        begins = np.cumsum(many) - many
        i, j = [], []
        for n in np.unique(many).tolist():
            a, b = np.triu_indices(n, 1)
            at = begins[many == n][:, None]
            i.append((at + a).ravel())
            j.append((at + b).ravel())
        i, j = np.concatenate(i), np.concatenate(j)
        other = roots_[i] != roots_[j]
        i, j = i[other], j[other]
        found = np.flatnonzero(pair_jaccards(sizes, values, i, j, threshold) >= threshold)
        return list(set(zip(ids[i[found]].tolist(), ids[j[found]].tolist())))

    def large(kind: int, group: list[tuple]) -> list[tuple]:
        """Links of a group, set by set; what is linked already isn't compared again."""
        ids, roots_ = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        if (roots_ == roots_[0]).all():
            return []
        sizes, values = sets([g[2] for g in group], kind)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        own = [values[a:a + n] for a, n in zip(starts, sizes)]
        found = []
        for i in range(1, len(group)):
            while True:
                near = (roots_[:i] != roots_[i]) & (sizes[:i] >= threshold * sizes[i]) & (sizes[i] >= threshold * sizes[:i])
                hit = next((j for j in np.flatnonzero(near) if jaccard(own[i], own[j]) >= threshold), None)
                if hit is None:
                    break
                found.append((int(ids[i]), int(ids[hit])))
                roots_[roots_ == roots_[hit]] = roots_[i]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[list[tuple]]] = {0: [], 1: []}
        met = 0

        def out(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, groups in waiting.items():
                if groups:
                    yield from out(small(kind, groups))
                groups.clear()

        def groups_of() -> Iterator[tuple[int, list[tuple]]]:
            at, group = None, []
            for batch in batches:
                for key, part, kind, *row in zip(*[c.to_pylist() for c in batch.columns]):
                    if (key, part, kind) != at:
                        if len(group) > 1:
                            yield at[2], group
                        at, group = (key, part, kind), []
                    group.append(tuple(row))
            if len(group) > 1:
                yield at[2], group

        for kind, group in groups_of():
            if len(group) > FEW:
                yield from out(large(kind, group))
                continue
            waiting[kind].append(group)
            met += sum(len(x[2]) for x in group)
            if met > 1 << 19:
                yield from flush()
                met = 0
        yield from flush()
        trim()

    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a bigint, b bigint")
