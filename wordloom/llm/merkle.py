"""A Merkle manifest of a dataset: each row a leaf, one tree a source, one tree over all sources.

Leaves are numbered within their source, and aligned blocks of FAN ** HEIGHT consecutive ones are traversed each by one task
in postorder: a call digests its children, returns its own digest and, while unwinding, appends each child's siblings to the
leaves that the child contains.  The roots of the blocks are the nodes of another such traversal, until one node is left
of each source; the sources' nodes, in order, are traversed likewise.  On the way back down a block takes along the siblings that lie above its
root, so that a leaf's whole proof is at hand where the block is.

Only digests travel, never texts; a source is split into blocks however large it is, and a block is one row of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import Tables, arrow_schema, crc_mod, cut, pick

#: Children of a node, and levels that one block spans.
FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT
#: Bytes of a digest.
SIZE = 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(children: list[bytes]) -> bytes:
    """H of a run of nodes: SHA-256 of their digests as hex text."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def height_of(n: int) -> int:
    """Levels above n nodes, until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


#: Siblings of a node on the way up: for each level the run that it is in, and its place there.
Path = list[tuple[list[bytes], int]]


def traverse(leaves: list[bytes], height: int, low: int = 0, paths: list[Path] | None = None) -> bytes:
    """The digest of the subtree of ``height`` levels over leaves[low:]; with ``paths``, each contained leaf's run of every level is appended to its own."""
    if not height:
        return leaves[low]
    width = FAN ** (height - 1)
    starts = range(low, min(low + width * FAN, len(leaves)), width)
    run = [traverse(leaves, height - 1, at, paths) for at in starts]
    if paths is not None:
        for place, at in enumerate(starts):
            for leaf in range(at, min(at + width, len(leaves))):
                paths[leaf].append((run, place))
    return digest(run)


def fold(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and its siblings give."""
    for run, place in path:
        leaf = digest([*run[:place], leaf, *run[place + 1:]])
    return leaf


def pack_path(path: Path) -> bytes:
    return b"".join(bytes([len(run), place]) + b"".join(run) for run, place in path)


def unpack_path(data: bytes) -> Path:
    at, out = 0, []
    while at < len(data):
        n, place = data[at], data[at + 1]
        out.append(([data[k:k + SIZE] for k in range(at + 2, at + 2 + n * SIZE, SIZE)], place))
        at += 2 + n * SIZE
    return out


def _split(data: bytes) -> list[bytes]:
    return [data[k:k + SIZE] for k in range(0, len(data), SIZE)]


def field(c: Column) -> Column:
    """A value as the leaves have it: ``-`` for null, else its bytes' count, a colon and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(df: DataFrame, tampered: Column) -> DataFrame:
    """tree (the source, made so that null comes first), doc_id, leaf and, where ``tampered``, the leaf with the text's A-Z in lower case."""
    rows = pick(df, *FIELDS)
    of = lambda text: F.unhex(F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)), 256))
    changed = F.when(tampered & F.col("text").rlike("[A-Z]"), of(lower_ascii(F.col("text"))))
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    return rows.select(tree.alias("tree"), "doc_id", of(F.col("text")).alias("leaf"), changed.alias("changed"))


def placed(tables: Tables, rows: DataFrame, tree: str | None, order: list[Column]) -> DataFrame:
    """Adds ``pos``, the place in the row's tree (in the table without one), from 0, in order; rows equal in all that is ordered by are alike.

    Rows are range-partitioned and sorted, each task counts its rows of each tree, and a row for each task and tree tells where they begin.  So a
    tree of any size is split, and the tie-breaker, a number that each row was given before, splits repeated rows too.
    """
    by = [tree] if tree else []
    numbered = tables.keep(rows.withColumn("_tie", F.monotonically_increasing_id()))
    keys = [*[F.asc(c) for c in by], *order, F.asc("_tie")]
    sorted_ = tables.keep(numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    sorted_ = sorted_.withColumn("_task", F.shiftright("_at", 33))
    counts = sorted_.groupBy(*by, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # A row for each task and tree, most trees in one task.
    window = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    begins = counts.select(*by, "_task", (F.coalesce(F.sum("_n").over(window), F.lit(0)) - F.col("_first")).alias("_shift"))
    return sorted_.join(begins, [*by, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _blocks(nodes: DataFrame, kind: str) -> DataFrame:
    """A row for each block of nodes (tree, pos, n, doc_id, leaf, changed): its nodes' packed digests and its root.

    A tree of one block is traversed to its own root; blocks of larger trees all have HEIGHT levels.
    """
    schema = f"tree string, n bigint, block bigint, height int, docs array<{kind}>, leaves binary, changed binary, which array<int>, root binary"
    out = arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, [], []

        def close() -> None:
            tree, block, n = at
            docs, own, other = zip(*held)
            height = HEIGHT if n > BLOCK else height_of(n)
            which = [i for i, x in enumerate(other) if x is not None]
            done.append((tree, n, block, height, list(docs), b"".join(own), b"".join(other[i] for i in which), which, traverse(list(own), height)))

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

        size = 0
        for b in batches:
            for tree, block, n, *node in zip(*[c.to_pylist() for c in b.columns]):
                if (tree, block, n) != at:
                    if held:
                        close()
                        size += len(held)
                        if size > 2 * BLOCK:
                            yield rows()
                            done, size = [], 0
                    at, held = (tree, block, n), []
                held.append(tuple(node))
        if held:
            close()
        if done:
            yield rows()

    dealt = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).select("tree", "block", "n", "doc_id", "leaf", "changed", "pos").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.drop("pos").mapInArrow(run, schema)


def _traversals(tables: Tables, nodes: DataFrame, kind: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks from the nodes up, and tree and leaf, the root, of each tree."""
    steps = []
    while True:
        blocks = tables.keep(_blocks(nodes, kind if not steps else "bigint"))
        steps.append(blocks)
        done = blocks.where(F.col("n") <= BLOCK).select("tree", F.col("root").alias("leaf"))
        roots = done if len(steps) == 1 else roots.union(done)
        more = blocks.where(F.col("n") > BLOCK)
        if more.isEmpty():
            return steps, roots
        nodes = more.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.lit(None).cast("bigint").alias("doc_id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("changed"))


def _expanded(blocks: DataFrame, kind: str | None = None) -> DataFrame:
    """tree, block and path of each node of blocks with a path; with ``kind``, nodes are named by doc_id instead, as trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, block, height, docs, data, up in zip(*[c.to_pylist() for c in b.columns]):
                own = _split(data)
                paths: list[Path] = [[] for _ in own]
                traverse(own, height, 0, paths)
                names = pa.array(docs if kind else [tree] * len(own), pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(range(block * BLOCK, block * BLOCK + len(own)), pa.int64()), pa.array([pack_path(p) + up for p in paths], pa.binary())], names=["tree", "block", "path"])

    return blocks.select("tree", "block", "height", "docs", "leaves", "path").mapInArrow(run, "tree string, block bigint, path binary")


def _with_paths(steps: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks with ``path``, the packed runs above their roots; above: tree and path of each tree's root."""
    found = None
    for blocks in reversed(steps):
        whole = blocks.where(F.col("n") <= BLOCK).join(above, "tree")
        parts = whole if found is None else whole.unionByName(blocks.where(F.col("n") > BLOCK).join(found, ["tree", "block"]))
        if blocks is not steps[0]:
            found = _expanded(parts)
    return parts


def _proofs(blocks: DataFrame, kind: str) -> DataFrame:
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, height, docs, data, changed, which, root, up in zip(*[c.to_pylist() for c in b.columns]):
                own, above = _split(data), unpack_path(up)
                paths: list[Path] = [[] for _ in own]
                traverse(own, height, 0, paths)
                subroot = fold(root, above[:height_of(n) - height])
                top = fold(root, above)
                other = dict(zip(which, _split(changed)))
                done = []
                for i, (doc, leaf, path) in enumerate(zip(docs, own, paths)):
                    proof = hashlib.sha256()
                    for run_, place in (*path, *above):
                        proof.update("".join([x.hex() for k, x in enumerate(run_) if k != place]).encode())
                    folded = fold(other.get(i, leaf), [*path, *above])
                    done.append((doc, leaf.hex(), subroot.hex(), top.hex(), proof.hexdigest(), folded.hex(), folded == top))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

    return blocks.select("n", "height", "docs", "leaves", "changed", "which", "root", "path").mapInArrow(run, schema)


def manifest(df: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row for each row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests are lower-case hex text.

    df has doc_id, source, lang, n_chars and text.  Nulls are hashed as ``-``, so any column may be null, and an empty or very long text is a
    leaf like any other.  ``tampered`` tells, by doc_id, of which rows a copy with the text's A-Z in lower case is held against the tree, by
    default where 5 divides the unsigned CRC-32 of the key's decimal text; never without a key.  Rows of a source without a key come after its
    others; repeated rows are leaves beside each other, in whichever order.  An empty table gives no rows.
    """
    tampered = crc_mod(F.col("doc_id"), 5) == 0 if tampered is None else tampered
    kind = dict(df.dtypes)["doc_id"]
    with Tables(df.sparkSession) as tables:
        rows = placed(tables, leaves(df, F.coalesce(tampered, F.lit(False))), "tree", [F.asc_nulls_last("doc_id"), F.asc("leaf")])
        steps, roots = _traversals(tables, rows.join(rows.groupBy("tree").agg(F.count("*").alias("n")), "tree"), kind)
        subroots = tables.keep(roots)
        # The trees' roots, by source, are the nodes of one more tree; each goes by its source's name.
        nodes = placed(tables, subroots, None, [F.asc("tree")]).select(F.lit("").alias("tree"), "pos", F.lit(subroots.count()).cast("bigint").alias("n"), F.col("tree").alias("doc_id"), "leaf", F.lit(None).cast("binary").alias("changed"))
        upper, _ = _traversals(tables, nodes, "string")
        start = df.sparkSession.range(1).select(F.lit("").alias("tree"), F.unhex(F.lit("")).alias("path"))
        above = _expanded(_with_paths(upper, start), "string").select("tree", "path")
        return cut(_proofs(_with_paths(steps, above), kind))
