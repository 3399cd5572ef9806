"""Connected components: local forests, then alternating large-star and small-star rounds (Kiveris et al., 2014).

Edges first meet by their larger end, and each task replaces its share, a bounded run at a time, by the stars of its own
components.  Then each round is two grouped minima and two joins, so no task ever holds a component; a node with
very many neighbours is pre-aggregated before the shuffle, and its join is an ordinary equi-join that AQE may split.
Once RUN edges or fewer are left, a bound that doesn't grow with the data, one task's forest is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut

#: Edges that a task holds at once.
RUN = 1_000_000


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites i and j in a forest of smallest positions, all pairs at once."""
    while len(i):
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the smallest of its component, and the smallest."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    parent = np.arange(len(nodes))
    merge(parent, at[:len(a)], at[len(a):])
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[below], nodes[parent[below]]


def _forests(edges: DataFrame, run_length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[pa.RecordBatch] = []

        def stars() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(got)
            a, b = forest(t.column(0).to_numpy(), t.column(1).to_numpy())
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k:k + 50_000]), pa.array(b[k:k + 50_000])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                got.append(batch)
            if sum(x.num_rows for x in got) >= run_length:
                yield from stars()
                got.clear()
        if got:
            yield from stars()

    return cut(edges.mapInArrow(run, "a bigint, b bigint"))


def connected_components(edges: DataFrame, most_rounds: int = 60, run_length: int = RUN) -> DataFrame:
    """edges: columns a and b, bigint.  Returns node and root, the smallest node reachable.

    The smallest node of a component and nodes without edges have no row; null ends and loops are ignored, repeated edges
    count once, no edges give no rows.  Raises if the rounds don't settle.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = _forests(e.repartition("a"), max(1, run_length))
    last = None
    for _ in range(most_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now[0] <= run_length:
            return _forests(e.coalesce(1), max(1, run_length + 1)).toDF("node", "root")
        if now == last:
            return e.toDF("node", "root")
        last = now
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("a <> m")).where("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m)
        e = cut(small.where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
