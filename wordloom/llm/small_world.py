"""Nearest neighbours by inner product: a hierarchical navigable small-world graph (Malkov and Yashunin, 2016) for each shard.

Vectors are dealt out by their hash; each shard's task makes its graph and writes it as flat neighbour arrays, a row a vector.  Every query is sent to all
shards, a shard's task reads its graph once and answers all of them in batches, and the shards' lists are merged.  The number of shards grows with the square root of
the table, so that both a graph's size and the number of graphs that a query visits stay far below it.

Inside a task, inserts and searches go in batches: the beams of many queries move on together, step by step, as array operations.  Graphs are made layer by
layer from the top; a batch meets the vectors inserted before it by such a search and its own members by comparing all of them.  Inner products become
angles: vectors are scaled to length one at most and get one component more, which fills that length up (Bachrach et al., 2014).

Equal vectors are one node with its few smallest ids.  A node that links would leave unreachable gets one more, so that a search
finds as many candidates as there are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import Tables, arrow_schema, cut, pick, trim

#: Links of a node in the upper layers and in the lowest, and places kept for links that make nodes reachable.
LINKS, LOWEST, SPARE = 32, 64, 4
#: Candidates kept while a graph is made and while it is searched; nodes of a beam that are left at a time.
BUILD, SEARCH, WIDE = 64, 128, 4
#: Nodes inserted and queries answered at once at most, and marks of visited nodes held.
BATCH, MARKS = 256, 1 << 25
#: A table of n vectors has sqrt(n / UNIT) shards, of MOST vectors at most.
UNIT, MOST = 1024, 1 << 18
#: Vectors that a task folds at once.
RUN = 1 << 17


@dataclass
class Graph:
    """Unit vectors, those of the higher layers first, and for each layer the links of its nodes; -1 is none."""

    x: np.ndarray
    layers: list[np.ndarray]


def _top(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.argsort(-score, axis=1)[:, :k]
    return np.take_along_axis(ids, at, 1), np.take_along_axis(score, at, 1)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``size`` nearest nodes that a search from its start (a column of nodes) meets, and their scores; best first, -1 where there are fewer."""
    n, width = links.shape
    every = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    seen[every, start] = True
    ids, score = np.full((len(q), size), n), np.full((len(q), size), -np.inf, np.float32)
    m = min(size, start.shape[1])
    ids[:, :m], score[:, :m] = _top(start, np.einsum("bsd,bd->bs", x[start], q), m)
    left = score == -np.inf
    live = np.arange(len(q))
    while len(live):
        open_ = ~left[live]
        some = open_.any(axis=1)
        live, open_ = live[some], open_[some]
        if not len(live):
            break
        turn = np.cumsum(open_, axis=1)
        row, col = np.nonzero(open_ & (turn <= WIDE))
        left[live[row], col] = True
        met = np.full((len(live), WIDE, width), n)
        met[row, turn[row, col] - 1] = links[ids[live[row], col]]
        met = np.sort(np.where(met < 0, n, met).reshape(len(live), -1), axis=1)
        new = ~seen[live[:, None], met]
        new[:, 1:] &= met[:, 1:] != met[:, :-1]
        seen[live[:, None], met] = True
        row, col = np.nonzero(new)
        more = np.full(met.shape, -np.inf, np.float32)
        more[row, col] = np.einsum("td,td->t", x[met[row, col]], q[live[row]])
        # Only the best of the new ones can enter.
        if met.shape[1] > size:
            best = np.argpartition(-more, size - 1, axis=1)[:, :size]
            met, more = np.take_along_axis(met, best, 1), np.take_along_axis(more, best, 1)
        both = np.concatenate([score[live], more], axis=1)
        at = np.argsort(-both, axis=1)[:, :size]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], met], axis=1), at, 1)
        score[live] = np.take_along_axis(both, at, 1)
        left[live] = np.take_along_axis(np.concatenate([left[live], more == -np.inf], axis=1), at, 1)
    return np.where(score == -np.inf, -1, ids), score


def diverse(x: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """Of each row's candidates, best first, those that none chosen before is nearer to than the row's own node, up to ``most``; with ``fill``, then the best others."""
    own = x[ids]
    near = own @ own.transpose(0, 2, 1)
    valid = score > -np.inf
    chosen, n = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
    for j in range(ids.shape[1]):
        ok = valid[:, j] & (n < most) & ~((near[:, j] >= score[:, j, None]) & chosen).any(axis=1)
        chosen[:, j] = ok
        n += ok
    take = chosen if not fill else chosen | valid
    at = np.argsort(np.where(chosen, 0, np.where(take, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1]), axis=1)[:, :most]
    out = np.where(np.take_along_axis(take, at, 1), np.take_along_axis(ids, at, 1), -1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, of: np.ndarray, most: int, step: int = 16) -> None:
    """Adds to each node in ``of`` (a row a new node) the new node; a node with too many links keeps diverse ones."""
    row, col = np.nonzero(of >= 0)
    to, source = of[row, col], new[row]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    rank = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
    for turn in range(0, int(rank.max(initial=-1)) + 1, step):
        mine = np.flatnonzero((rank >= turn) & (rank < turn + step))
        nodes, at = np.unique(to[mine], return_inverse=True)
        more = np.full((len(nodes), step), -1)
        more[at, rank[mine] - turn] = source[mine]
        for k in range(0, len(nodes), 1024):
            some = nodes[k:k + 1024]
            all_ = np.concatenate([links[some, :most], more[k:k + 1024]], axis=1)
            # Links first, then free places.
            all_ = np.take_along_axis(all_, np.argsort(all_ < 0, axis=1, kind="stable"), 1)
            over = (all_ >= 0).sum(axis=1) > most
            links[some[~over], :most] = all_[~over, :most]
            if over.any():
                ids, own = all_[over], some[over]
                score = np.where(ids < 0, -np.inf, np.einsum("bsd,bd->bs", x[ids], x[own])).astype(np.float32)
                ids, score = _top(ids, score, ids.shape[1])
                links[own, :most] = diverse(x, ids, score, most, fill=False)


def _descend(g: Graph, q: np.ndarray, lowest: int) -> np.ndarray:
    """For each query a node near it, by a narrow search of the layers down to ``lowest``."""
    at = np.zeros((len(q), 1), int)
    for layer in range(len(g.layers) - 1, lowest - 1, -1):
        at = beam(g.x, g.layers[layer], q, at, 4)[0][:, :1]
    return at


def _batch(n: int) -> int:
    return max(8, min(BATCH, MARKS // (n + 1)))


def _fill(g: Graph, layer: int, n: int, upper: int, most: int) -> None:
    """Inserts nodes 0 to n - 1 into a layer, whose first ``upper`` are in the layer above."""
    links, x, a = g.layers[layer], g.x, 0
    while a < n:
        b = min(n, a + min(max(a, 64), _batch(n)))
        # Below the layer above's size, not all of its nodes are here yet.
        if a < upper < b:
            b = upper
        q, new = x[a:b], np.arange(a, b)
        score = q @ q.T
        np.fill_diagonal(score, -np.inf)
        ids = np.broadcast_to(new, score.shape)
        if a:
            start = _descend(g, q, layer + 1) if a >= upper and layer + 1 < len(g.layers) else np.zeros((b - a, 1), int)
            found, near = beam(x, links[:a], q, start, BUILD)
            ids, score = np.concatenate([found, ids], axis=1), np.concatenate([near, score], axis=1)
        ids, score = _top(ids, score, BUILD)
        links[a:b, :LINKS] = diverse(x, ids, score, LINKS, fill=True)[:, :LINKS]
        _link_back(x, links, new, links[a:b, :LINKS], most)
        a = b


def _reached(links: np.ndarray) -> np.ndarray:
    seen, edge = np.zeros(len(links), bool), np.zeros(1, int)
    seen[0] = True
    while len(edge):
        edge = np.unique(links[edge])
        edge = edge[edge >= 0]
        edge = edge[~seen[edge]]
        seen[edge] = True
    return seen


def _join(x: np.ndarray, links: np.ndarray) -> None:
    """Links nodes that can't be reached from the first one: from near ones that have a place left."""
    while not (seen := _reached(links)).all():
        lost = np.flatnonzero(~seen)[:_batch(len(x))]
        found, _ = beam(x, links, x[lost], np.zeros((len(lost), 1), int), BUILD)
        rest: Iterator[int] | None = None
        for node, near in zip(lost.tolist(), found.tolist()):
            place = next((p for p in near if p >= 0 and (links[p] < 0).any()), None)
            if place is None:
                rest = rest or iter(np.flatnonzero(seen & (links < 0).any(axis=1)).tolist())
                place = next(p for p in rest if (links[p] < 0).any())
            links[place, int((links[place] < 0).argmax())] = node


def levels(ids: np.ndarray) -> np.ndarray:
    """Each node's layer, by a hash of its id: a LINKS-th of each layer's nodes are in the next."""
    h = (ids.astype(np.int64).view(np.uint64) + np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    return np.minimum(-np.log(u) / math.log(LINKS), 12).astype(np.int64)


def unit(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors scaled by the longest one's length, with a component more that makes all of length one; and that length."""
    v = vectors.astype(np.float64)
    peak = np.abs(v).max()
    v = v / peak
    most = np.sqrt((v * v).sum(axis=1).max())
    v /= most
    rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1, keepdims=True)))
    return np.concatenate([v, rest], axis=1).astype(np.float32), float(peak * most)


def build(vectors: np.ndarray, level: np.ndarray) -> Graph:
    """The graph of distinct vectors, whose levels must not rise."""
    g = Graph(unit(vectors)[0], [])
    sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)]
    g.layers = [np.full((n, LINKS if k else LOWEST + SPARE), -1, np.int32) for k, n in enumerate(sizes)]
    for k in range(len(sizes) - 1, -1, -1):
        _fill(g, k, sizes[k], sizes[k + 1] if k + 1 < len(sizes) else 0, LINKS if k else LOWEST)
        _join(g.x, g.layers[k]) if not k else None
    return g


def search(g: Graph, q: np.ndarray, size: int = SEARCH) -> np.ndarray:
    """For each query (a row) about the ``size`` nodes of largest inner product; -1 where there are fewer."""
    q = q.astype(np.float64)
    peak = np.abs(q).max(axis=1, keepdims=True)
    q = q / peak
    q = np.pad(q / np.sqrt((q * q).sum(axis=1, keepdims=True)), ((0, 0), (0, 1))).astype(np.float32)
    return beam(g.x, g.layers[0], q, _descend(g, q, 1), size)[0]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k].astype(np.float64) * b[:, k]
    return out


def _vectors(rows: DataFrame) -> tuple[DataFrame, type]:
    """vec_id and vector, packed, of the rows that take part; and the type of components."""
    kind = np.float32 if rows.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    element = rows.schema["embedding"].dataType.elementType
    rows = rows if element in (T.FloatType(), T.DoubleType()) else rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zeros
            ends = np.r_[0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))] * x.itemsize
            yield pa.RecordBatch.from_arrays([b.column(0), pa.BinaryArray.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)])], names=["vec_id", "vector"])

    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, vector binary"), kind


def shards_of(n: int) -> int:
    return max(1, math.ceil(math.sqrt(n / UNIT)), -(-n // MOST))


def index(df: DataFrame, shards: int, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each distinct vector: shard, width (components), slot, level, ids (the k + 1 smallest), vector and links, its lists of each layer one after the other.

    Vectors of different numbers of components are never in one graph.  Copies inside a task fold before they travel, so one that a third of the rows repeat is a row a task.
    """
    packed, kind = _vectors(pick(df, key, vector).toDF("vec_id", "embedding"))
    keep = k + 1

    def few(a: list[int]) -> list[int]:
        return heapq.nsmallest(keep, set(a))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for at in range(0, len(names), 4096):
                part = names[at:at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([few(held[v]) for v in part], pa.list_(pa.int64()))], names=["vector", "ids"])

        for b in batches:
            for i, v in zip(*[c.to_pylist() for c in b.columns]):
                own = held.setdefault(v, [])
                own.append(i)
                if len(own) > 8 * keep:
                    held[v] = few(own)
            if len(held) > RUN:
                yield from out()
                held.clear()
        yield from out()

    schema = "shard int, width int, slot int, level int, ids array<bigint>, vector binary, links binary"
    types = arrow_schema(T._parse_datatype_string(schema))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards_: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        for b in batches:
            for s, v, ids in zip(*[c.to_pylist() for c in b.columns]):
                own = shards_.setdefault((s, len(v)), {})
                own[v] = few(own[v] + ids) if v in own else ids
        for (s, size), nodes in shards_.items():
            vectors = np.frombuffer(b"".join(nodes), kind).reshape(len(nodes), -1)
            first = np.array([ids[0] for ids in nodes.values()])
            level = levels(first)
            # Ties, which only repeated ids make, are settled by the vectors.
            names = list(nodes)
            order = sorted(range(len(names)), key=lambda i: (-level[i], first[i], names[i]))
            level, vectors = level[order], vectors[order]
            g = build(vectors, level)
            for at in range(0, len(order), 4096):
                some = range(at, min(at + 4096, len(order)))
                links = [b"".join(g.layers[j][i].tobytes() for j in range(level[i] + 1)) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(([s] * len(some), [vectors.shape[1]] * len(some), list(some), level[at:at + 4096].tolist(), [nodes[names[order[i]]] for i in some], [names[order[i]] for i in some], links), types)], schema=types
                )
        trim()

    folded = packed.mapInArrow(fold, "vector binary, ids array<bigint>")
    dealt = folded.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "vector", "ids")
    return dealt.repartitionById(shards, "shard").mapInArrow(make, schema)


def _load(rows: list[tuple], kind: type) -> tuple[Graph, np.ndarray, list[list[int]]]:
    """A graph, its vectors and its nodes' ids from index rows (slot, level, ids, vector, links) in order."""
    _, level, ids, vectors, links = zip(*rows)
    vectors = np.frombuffer(b"".join(vectors), kind).reshape(len(rows), -1)
    flat = np.frombuffer(b"".join(links), np.int32)
    begins = np.r_[0, np.cumsum([len(x) // 4 for x in links])[:-1]]
    g = Graph(unit(vectors)[0], [])
    for k in range(level[0] + 1):
        n, width = sum(x >= k for x in level), LINKS if k else LOWEST + SPARE
        at = begins[:n] + (LOWEST + SPARE + (k - 1) * LINKS if k else 0)
        g.layers.append(flat[at[:, None] + np.arange(width)])
    return g, vectors, list(ids)


def answers(indexed: DataFrame, queries: DataFrame, kind: type, shards: int, k: int, size: int = SEARCH) -> DataFrame:
    """query_id, vector, vec_id and score: of each shard the k nearest to each query (vec_id, vector) that are not of its own id."""
    none = lambda kind: F.lit(None).cast(kind)
    item = np.dtype(kind).itemsize
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.length("vector") / item).cast("int").alias("width"), F.lit(1).alias("asks"), none("int").alias("slot"), none("int").alias("level"), F.array("vec_id").alias("ids"), "vector", none("binary").alias("links"))
    nodes = indexed.select("shard", "width", F.lit(0).alias("asks"), "slot", "level", "ids", "vector", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, graph, waiting = None, [], None, []

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal graph
            if graph is None:
                graph = _load(rows, kind)
                rows.clear()
            g, vectors, ids = graph
            own = [q[0][0] for q in waiting]
            q = np.frombuffer(b"".join([q[1] for q in waiting]), kind).reshape(len(waiting), -1)
            found = search(g, q, max(size, 2 * k))
            row, col = np.nonzero(found >= 0)
            node = found[row, col]
            score = products(q[row], vectors[node])
            best: list[list[tuple[float, int]]] = [[] for _ in own]
            for r, n, s in zip(row.tolist(), node.tolist(), score.tolist()):
                best[r] += [(-s, i) for i in ids[n] if i != own[r]]
            out = [(own[r], waiting[r][1], i, -s) for r, b in enumerate(best) for s, i in heapq.nsmallest(k, b)]
            waiting.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.float64()))], names=["query_id", "vector", "vec_id", "score"])

        for b in batches:
            for shard, width, asks, *row in zip(*[c.to_pylist() for c in b.columns]):
                if (shard, width) != at:
                    if waiting:
                        yield from answered()
                    at, rows, graph = (shard, width), [], None
                if not asks:
                    rows.append(tuple(row))
                elif rows or graph:
                    waiting.append((row[2], row[3]))
                    if len(waiting) >= _batch(len(rows) or len(graph[1])):
                        yield from answered()
        if waiting:
            yield from answered()
        trim()

    dealt = nodes.union(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "width", "asks", "slot")
    return dealt.mapInArrow(run, "query_id bigint, vector binary, vec_id bigint, score double")


def nearest(df: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", shards: int | None = None, size: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product found for each row whose key ``every`` divides, its own key's left out.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do rows without a key.  Equal scores go by key; repeated rows count once,
    and a key that has several vectors asks with each, best first over all of them.  Vectors of other lengths aren't compared.  An empty table gives no rows.
    """
    rows = pick(df, key, vector).toDF("vec_id", "embedding")
    shards = shards or shards_of(rows.count())
    with Tables(df.sparkSession) as tables:
        packed, kind = _vectors(rows.where(F.pmod(F.col("vec_id").cast("bigint"), F.lit(every)) == 0))
        indexed = tables.keep(index(rows, shards, k))
        found = answers(indexed, packed.distinct(), kind, shards, k, size)
        order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return cut(ranked.select("query_id", "rank", "vec_id", "score"))
