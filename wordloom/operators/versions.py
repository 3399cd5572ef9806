"""Versions of a package as hash trees over ranges of names, so that two versions are compared by what differs (SNK-17, VAR-33).

A file is in one of 16 ** DEPTH ranges by the hash of its name.  A range's digest is that of its files' names and contents, in order, and a node's is that of
its sixteen children; the id of a version is the root's digest.  So it isn't the flat hash of all files that ``export.version_id`` gives, but no task ever holds all of
them, and a change touches DEPTH + 1 digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels below the root; a range of a package of a million files has 250.
DEPTH = 3


def in_ranges(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Files (path, content) with ``range``, a hex text: to be written partitioned by it."""
    return files.withColumn("range", F.substring(F.sha2("path", 256), 1, depth))


def tree(ranged: DataFrame, depth: int = DEPTH) -> DataFrame:
    """node (the range's hex text, empty for the root) and digest, on every level; no files give a root alone.

    ranged: path, content and range.  Equal names are told apart by content; a null content counts as empty.
    """
    line = F.concat("path", F.lit("\0"), F.sha2(F.coalesce("content", F.lit(b"")), 256))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256).alias("digest")
    level = ranged.select(F.col("range").alias("node"), line.alias("_line")).groupBy("node").agg(joined("_line"))
    out = level
    for n in range(depth - 1, -1, -1):
        up = level.select(F.substring("node", 1, n).alias("node") if n else F.lit("").alias("node"), F.concat("node", F.lit("\0"), "digest").alias("_line"))
        # The root is there even for no files.
        level = up.groupBy("node").agg(joined("_line")) if n else up.agg(joined("_line")).select(F.lit("").alias("node"), "digest")
        out = out.unionByName(level)
    return out


def root(nodes: DataFrame) -> DataFrame:
    """version: the id of a version from its tree."""
    return nodes.where("node = ''").select(F.col("digest").alias("version"))


def changed_ranges(old: DataFrame, new: DataFrame, depth: int = DEPTH) -> list[str]:
    """The ranges in which two trees differ: from the root down, only children of nodes that differ are looked at.

    As many names as there are changed ranges, 16 ** depth at most, come to the driver.
    """
    nodes = [""]
    for n in range(depth + 1):
        some = lambda t: t.where((F.length("node") == n) & F.substring("node", 1, max(0, n - 1)).isin(nodes))  # noqa: B023, E731
        both = some(old).join(some(new).withColumnRenamed("digest", "_digest"), "node", "full_outer")
        nodes = sorted(r.node for r in both.where(~F.col("digest").eqNullSafe(F.col("_digest"))).select("node").collect())
        if not nodes:
            return []
    return nodes


def changes(old: DataFrame, new: DataFrame, ranges: list[str]) -> DataFrame:
    """path and change (added, removed, changed) in the ranges given; tables partitioned by range are read there only.  A name is one file."""
    some = lambda df, c: df.where(F.col("range").isin(ranges)).select("path", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias(c))
    both = some(old, "_old").join(some(new, "_new"), "path", "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select("path", kind.alias("change")).where("change IS NOT NULL")
