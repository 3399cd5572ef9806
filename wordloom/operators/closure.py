"""What lies below nodes of trees, by pointer doubling: as many rounds as the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.tables import cut


def _jumps(edges: DataFrame, by: list[str]) -> DataFrame:
    return cut(edges.where("parent IS NOT NULL AND node IS NOT NULL AND parent <> node").select(*by, "node", F.col("parent").alias("above")).distinct())


def _twice(jumps: DataFrame, by: list[str]) -> DataFrame:
    """From ancestors 2 ** k above to those 2 ** (k + 1) above."""
    return cut(jumps.join(jumps.select(*by, F.col("node").alias("above"), F.col("above").alias("_far")), [*by, "above"]).select(*by, "node", F.col("_far").alias("above")).distinct())


def below(edges: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """root and node: each root (``by`` and root) with itself and all nodes under it, JOIN-17, LNG-03; edges: ``by``, node, parent.

    Round k knows what is less than 2 ** k levels below and each node's ancestor 2 ** k levels above, and joins the two.  It ends when a
    round finds nothing, so cycles end it too: a node is under a root if any way up from it leads there, however often.
    A node may have several parents; its own parent and null ends count as none.
    """
    found, jumps = cut(roots.select(*by, "root", F.col("root").alias("node")).where("root IS NOT NULL").distinct()), _jumps(edges, by)
    n = found.count()
    while True:
        deeper = jumps.join(found.withColumnRenamed("node", "above"), [*by, "above"]).select(*by, "root", "node")
        more = cut(found.select(*by, "root", "node").union(deeper).distinct())
        now = more.count()
        if now == n:
            return more
        found, n, jumps = more, now, _twice(jumps, by)


def endless(edges: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and node: nodes on a cycle or below one; no way up from them ends.  Each node has one parent at most.

    A node with an ancestor as many levels above as its group has nodes is one of them.
    """
    jumps = _jumps(edges, by)
    most = edges.groupBy(*by).agg(F.count_distinct("node").alias("n")).agg(F.max("n")).first()[0] or 0
    far = 1
    while far <= most and not jumps.isEmpty():
        jumps, far = _twice(jumps, by), 2 * far
    return jumps.select(*by, "node").distinct()
