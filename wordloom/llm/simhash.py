"""Near-duplicates by 64-bit SimHash, searched through a Gray-order hierarchical index.

Fingerprints: the words of a text (A-Z lowered, split at ASCII white space) give 4-word shingles with repeats; a
bit is set if it is set in over half of their XXH64 values.

Search: two fingerprints that differ in ``k`` bits at most agree on one of k + 1 blocks of bits.  Each distinct
fingerprint is therefore placed k + 1 times, rotated so that one block leads, and partitioned by that block.  A
task sorts its share by Gray rank and builds an index on it: leaves are runs of neighbours in that order, each node
factors out the bits that all below it share (a mask and a pattern), and upper nodes group lower ones.  Two nodes are
compared by the bits that both have factored out; a pair whose accumulated differences exceed k is pruned with all
below it.  Nodes that are already linked as a whole are pruned too, so a ball of near copies costs about one
comparison for each member rather than one for each pair.  A task returns a spanning forest of the links that it
found, never the pairs, and the forests meet in a distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut, map_rows, pick, plain
from wordloom.llm.components import connected_components, merge

WIDTH = 64
#: Rows in a leaf, and children of an upper node.
FAN = 16
#: Rows of a block value that a task indexes at once; one with more is dealt out as pairs of chunks of about half that.
CHUNK = 100_000
#: Node pairs expanded at once; bounds a task's memory.
FRONTIER = 4096


def simhash(text: str | None, words_in_shingle: int = 4) -> int:
    """The fingerprint, 0 for a null text or one without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    k = min(words_in_shingle, len(words))
    h = [xxhash.xxh64_intdigest(joined[a:b - 1], 42) for a, b in zip([0, *ends], ends[k - 1:])]
    total = np.zeros(WIDTH, np.int64)
    for i in range(0, len(h), 4096):
        total += np.unpackbits(np.array(h[i:i + 4096], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words_in_shingle: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; one row for each row."""

    def start():
        def f(keys: list, texts: list) -> list[tuple]:
            fps = np.array([simhash(t, words_in_shingle) for t in texts], np.uint64).view(np.int64)
            return list(zip(keys, fps.tolist()))

        return f

    return map_rows(pick(df, key, text), f"doc_id {dict(df.dtypes)[key]}, fp bigint", start)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of a word in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def index_links(group: np.ndarray, fp: np.ndarray, k: int) -> np.ndarray:
    """For each row the smallest row that links of k bits reach inside its group; rows are sorted by group and Gray rank."""
    n = len(fp)
    parent = np.arange(n)
    if n < 2:
        return parent
    levels = [(fp, ~np.zeros(n, np.uint64), group, np.arange(n), np.arange(n) + 1)]
    while True:
        pattern, mask, owner, low, high = levels[-1]
        new = np.r_[True, owner[1:] != owner[:-1]]
        first = np.flatnonzero(new)
        at = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        heads = np.flatnonzero(at % FAN == 0)
        all_, none = np.bitwise_and.reduceat(pattern, heads), np.bitwise_or.reduceat(pattern, heads)
        shared = np.bitwise_and.reduceat(mask, heads) & ~(all_ ^ none)
        tails = np.r_[heads[1:], len(owner)]
        levels.append((all_ & shared, shared, owner[heads], heads, tails))
        if len(heads) == len(first):
            break
    spans = [(np.arange(n), np.arange(n) + 1)]
    for _, _, _, low, high in levels[1:]:
        spans.append((spans[-1][0][low], spans[-1][1][high - 1]))
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    roots = roots[spans[top][1] - spans[top][0] > 1]
    stack = [(top, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > FRONTIER:
            stack.append((level, a[FRONTIER:], b[FRONTIER:]))
            a, b = a[:FRONTIER], b[:FRONTIER]
        low, high = spans[level]
        root_a, root_b = parent[low[a]], parent[low[b]]
        one = (root_a == root_b) & _uniform(parent, low, high, a) & _uniform(parent, low, high, b)
        a, b = a[~one], b[~one]
        if not len(a):
            continue
        pattern, mask, _, _, _ = levels[level - 1]
        _, _, _, first, last = levels[level]
        na, nb = last[a] - first[a], last[b] - first[b]
        count = na * nb
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ca = np.repeat(first[a], count) + at // np.repeat(nb, count)
        cb = np.repeat(first[b], count) + at % np.repeat(nb, count)
        near = (ca <= cb if level > 1 else ca < cb) & (np.bitwise_count(mask[ca] & mask[cb] & (pattern[ca] ^ pattern[cb])) <= k)
        ca, cb = ca[near], cb[near]
        if level == 1:
            merge(parent, ca, cb)
        elif len(ca):
            stack.append((level - 1, ca, cb))
    return parent


def _uniform(parent: np.ndarray, low: np.ndarray, high: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether all rows below a node have one root already."""
    if not len(nodes):
        return np.zeros(0, bool)
    changes = np.r_[0, np.cumsum(parent[1:] != parent[:-1])]
    return changes[high[nodes] - 1] == changes[low[nodes]]


def hamming_links(fps: DataFrame, k: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all those within k bits of each other.

    Only a spanning forest for each block value comes back, k + 1 rows for each fingerprint at most.
    """
    blocks = k + 1
    sizes = [WIDTH // blocks + (i < WIDTH % blocks) for i in range(blocks)]
    shift = list(accumulate([0, *sizes]))[:-1]
    turned = F.array(*[F.struct(F.lit(i).alias("turn"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).cast("int").alias("block")) for i, (s, w) in enumerate(zip(shift, sizes))])
    rows = fps.select("fp", F.explode(turned).alias("g")).select("fp", "g.turn", "g.block")
    # As many block values as a fingerprint's bits allow, 2^13 for each of the k + 1 blocks, bound this list.
    hot = [tuple(r) for r in rows.groupBy("turn", "block").count().where(F.col("count") > chunk).collect()]
    rows = rows.withColumn("part", F.lit(0))
    if hot:
        spark = fps.sparkSession
        named = F.broadcast(spark.createDataFrame([(t, b, -(-2 * n // chunk)) for t, b, n in hot], "turn int, block int, chunks int"))
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(j, mine) * F.col("chunks") + F.greatest(j, mine))
        rows = rows.join(named, ["turn", "block"], "left").select("fp", "turn", "block", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"))

    def index(fp: np.ndarray, turn: np.ndarray, block: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = fp.view(np.uint64)
        by = np.array(shift, np.uint64)[turn]
        leading = np.where(by == 0, fp, (fp >> by) | (fp << ((np.uint64(64) - by) % np.uint64(64))))
        # The leading block is the lowest bits here; turned round it is the highest, as Gray order wants.
        order = np.lexsort((gray_rank(_reversed(leading)), part, block, turn))
        fp, turn, block, part = fp[order], turn[order], block[order], part[order]
        new = np.r_[True, (turn[1:] != turn[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])]
        parent = index_links(np.cumsum(new), fp, k)
        linked = np.flatnonzero(parent != np.arange(len(fp)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[parent[linked]].view(np.int64))], names=["a", "b"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if sum(len(x[0]) for x in held) < chunk:
                continue
            # Rows come group by group; the last group may go on.
            fp, *group = (np.concatenate(c) for c in zip(*held))
            same = np.logical_and.reduce([g == g[-1] for g in group])
            end = len(fp) - int(same.sum())
            if end:
                yield from index(fp[:end], *[g[:end] for g in group])
                held = [[fp[end:], *[g[end:] for g in group]]]
        if held:
            yield from index(*(np.concatenate(c) for c in zip(*held)))

    return rows.repartition("turn", "block", "part").sortWithinPartitions("turn", "block", "part").mapInArrow(links, "a bigint, b bigint")


def _reversed(x: np.ndarray) -> np.ndarray:
    """The 64 bits in the other order."""
    b = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(b, axis=1, bitorder="little"), axis=1).view(">u8").reshape(-1).astype(np.uint64)


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, words_in_shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row.

    component_id is the smallest key that links of k bits or fewer reach.  Null, empty and wordless texts have
    fingerprint zero and are linked like any other.  A null key is never a component's id while the component has
    another.  Repeated rows each come back; an empty table gives no rows.
    """
    fps = cut(fingerprints(df, key, text, words_in_shingle))
    least = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(hamming_links(least.select("fp"), k)).withColumnsRenamed({"node": "fp"})
    named = least.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """One document of each component stays, the one with the smallest key, with all its columns.

    Rows of one key have one fate: they all stay if one of their texts is their component's smallest, so repeated rows do.  Rows
    without a key stay.  Null and empty texts are copies of each other.  An empty table stays empty; other columns, even
    ones whose names differ only in case, aren't touched.
    """
    gone = simhash_components(df, key, text, k).where("doc_id <> component_id").select("doc_id").distinct().withColumnRenamed("doc_id", "gone_key")
    rows = plain(df)
    return rows.join(gone, rows[f"c{df.columns.index(key)}"] == gone["gone_key"], "left_anti").toDF(*df.columns)
