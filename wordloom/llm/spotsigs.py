"""Document fingerprints by SpotSigs (Theobald, Siddharth and Paepcke, 2008).

Each common word of a text is an anchor; the anchor and the CHAIN content words that follow it, other common words
skipped, are one signature, and the set of signatures is the fingerprint.  Content words are thereby tied to prose,
and a change touches few signatures.  Common are the listed words of four languages and, so that others have anchors
too, all words that make up SHARE or more of the table's words, counted over all texts.

Near-duplicate search: sets are partitioned by length, so that only neighbouring partitions can hold a set of
Jaccard index t or more; inside, a set posts only the prefix of its sorted signatures that any such partner
must share, and pairs that meet are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import arrow_schema, cut, map_rows, pick, shared, trim
from wordloom.llm.set_links import jaccard, set_classes

#: Common words of English, French, German and Spanish.
COMMON = frozenset(
    "a an and are as at be been but by can for from had has have he her his if in is it its not of on or she so that the their there they this to was we were what when which who will with you "
    "au aux avec ce cette dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour qui que sa se ses son sont sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht oder sich sie sind und von war wie zu zum zur "
    "al como con del el ella ese esta este ha las lo los más muy no o para pero por ser sin su sus te una uno y ya".split()
)
CHAIN = 2
WORD = re.compile(r"[^\W_]+")
#: A word that makes up this share of all words is common; so there are 1 / SHARE of them at most.
SHARE = 1 / 1000
#: Word hashes that a task remembers before it starts anew.
REMEMBERED = 100_000
#: Documents of one stretch of neighbouring keys, about.
STRETCH = 2500
_COMMON = np.uint64(1 << 32)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Hashes(dict):
    """A word's 32-bit hash, with a flag for common words."""

    def __init__(self, common: frozenset[str] = COMMON) -> None:
        super().__init__()
        self.common = common

    def __missing__(self, w: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[w] = h = zlib.crc32(w.encode("utf-8", "surrogatepass")) | (w in self.common) << 32
        return h


def frequent_words(df: DataFrame, text: str = "text", share: float = SHARE) -> list[str]:
    """The words that make up ``share`` or more of all words of all texts, in code-point order.

    A word with that share of the table has it in some task's texts, so each task names the words that may have it in its
    own, by lossy counting in bounded memory; these candidates are then counted exactly over all texts.
    """
    rows = pick(df, text).where(f"{text} IS NOT NULL").toDF("text")
    slack = share / 2

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A count and how many may have been missed before it began.
        met: dict[str, list[int]] = {}
        n, pruned = 0, 0
        for b in batches:
            for t in b.column(0):
                words = WORD.findall(t.as_py().lower())
                n += len(words)
                missed = int(slack * pruned)
                for w, k in Counter(words).items():
                    if (own := met.get(w)) is None:
                        met[w] = [k, missed]
                    else:
                        own[0] += k
                if len(met) > REMEMBERED:
                    pruned = n
                    met = {w: x for w, x in met.items() if x[0] + x[1] > slack * n}
        found = [w for w, (k, missed) in met.items() if k + missed >= share * n]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["word"])

    # 1 / share words for each task at most, most of them alike.
    some = frozenset(r.word for r in rows.mapInArrow(candidates, "word string").distinct().collect())

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                words = WORD.findall(t.as_py().lower())
                met[""] += len(words)
                met.update(filter(some.__contains__, words))
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=["word", "n"])

    total = {r.word: r.n for r in rows.mapInArrow(counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sorted(w for w, n in total.items() if w and n >= share * total[""])


def signatures(text: str | None, chain: int = CHAIN, hashes: Hashes | None = None) -> np.ndarray:
    """The sorted distinct 32-bit signatures of a text.

    Chains count with their repeats: a chain's second occurrence is a signature of its own, and so on, so the Jaccard index
    of two such sets is that of the multisets.  A text with words but without a whole chain has its words as signatures;
    a text without words has one, of its characters; an empty or null text none.
    """
    words = WORD.findall((text or "").lower())
    if not words:
        return np.array([zlib.crc32(text.encode())], np.uint32) if text else np.zeros(0, np.uint32)
    h = np.fromiter(map((Hashes() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    common = (h & _COMMON) != 0
    content, anchors = np.flatnonzero(~common), np.flatnonzero(common)
    after = np.searchsorted(content, anchors, side="right")
    whole = after + chain <= len(content)
    anchors, after = anchors[whole], after[whole]
    x = h[anchors] * _P if len(anchors) else h * _P
    for i in range(chain if len(anchors) else 0):
        x ^= x >> np.uint64(29)
        x = (x ^ h[content[after + i]]) * _P
    x.sort()
    first = np.searchsorted(x, x)
    again = (np.arange(len(x)) - first).astype(np.uint64)
    x ^= again * _Q
    return np.unique(((x * _P) >> np.uint64(32)).astype(np.uint32))


def as_text(signatures_: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits for each signature, in order."""
    return signatures_.astype(">u4").tobytes().hex()


def anchors_of(df: DataFrame, text: str = "text") -> Callable[[], Hashes]:
    """What gives, in a worker, the word hashes with the table's common words."""
    return shared(df, COMMON | frozenset(frequent_words(df, text)), Hashes)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", chain: int = CHAIN, anchors: Callable[[], Hashes] | None = None) -> DataFrame:
    """doc_id and signatures (binary, sorted unsigned 32-bit little-endian), one row for each row."""
    anchors = anchors or anchors_of(df, text)

    def start():
        hashes = anchors()
        return lambda keys, texts: [(k, signatures(t, chain, hashes).astype("<u4").tobytes()) for k, t in zip(keys, texts)]

    return map_rows(pick(df, key, text), f"doc_id {dict(df.dtypes)[key]}, signatures binary", start)


def similar_classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id and class_id, the smallest key of the documents that links of Jaccard index ``threshold`` or more reach.

    One row for each row; equal fingerprints are one set, empty ones too.  A null key is a class's id only where no row
    of the class has a key.
    """
    prints = cut(fingerprints(df, key, text))
    sets = cut(prints.groupBy("signatures").agg(F.min("doc_id").alias("least")).select(F.monotonically_increasing_id().alias("id"), "signatures", "least"))

    def postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, ids = [np.zeros(0, np.uint64)], []
        for i, data in zip(*[c.to_pylist() for c in batch.columns]):
            s = np.frombuffer(data, "<u4")
            n = len(s)
            part = int(math.log(n) / -math.log(threshold)) if n else 0
            prefix = s[:n - math.ceil(threshold * n - 1e-9) + 1 if n else 0].astype(np.uint64)
            for p in (part, part + 1):
                keys.append((prefix + np.uint64(p << 32)) * _P)
                ids.append(np.full(len(prefix), i, np.int64))
        return np.concatenate(keys), np.concatenate(ids) if ids else np.zeros(0, np.int64)

    with_data = lambda df: df.join(sets.select("id", F.col("signatures").alias("data")), "id")
    roots = set_classes(sets.select("id", "signatures"), postings, 40, lambda ids: with_data, _sets, threshold)
    named = sets.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = named.groupBy("root").agg(F.min("least").alias("class_id"))
    return prints.join(named.join(heads, "root").select("signatures", "class_id"), "signatures").select("doc_id", "class_id")


def _sets(data: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures are 32 bits; they are the highest of the values compared."""
    return np.array([len(x) // 4 for x in data]), np.frombuffer(b"".join(data), "<u4").astype(np.uint64) << np.uint64(32)


def _stretches(rows: DataFrame) -> np.ndarray:
    """Keys at which a new stretch of neighbouring documents begins: approximate quantiles, evenly subdivided."""
    n = -(-rows.count() // STRETCH)
    if n < 2:
        return np.zeros(0, np.int64)
    coarse = min(n, 512)
    marks = rows.stat.approxQuantile("doc_id", [i / coarse for i in range(coarse + 1)], 0.1 / coarse)
    fine = -(-n // coarse)
    inner = [np.linspace(a, b, fine, endpoint=False) for a, b in zip(marks, marks[1:])]
    return np.unique(np.ceil(np.concatenate(inner)).astype(np.int64)[1:])


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    The last quarter of a text's code points gives way to as many of the next document's first ones; documents follow
    each other by key, and the last is followed by the first.  Rows of one key follow each other by text, rows without
    a key come before all others.  Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and n_signatures, one row for each row.

    Documents are dealt out by stretches of keys and each stretch is read as a stream, together with the document that
    follows its last one.  So each text travels once, and no task orders the whole table.
    """
    rows = pick(df, key, text).toDF("doc_id", "raw").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("raw", F.lit("")).alias("raw"))
    marks = _stretches(rows.select("doc_id"))
    sent, anchors = df.sparkSession.sparkContext.broadcast(marks), anchors_of(df, text)

    @F.pandas_udf("int")
    def stretch(keys):
        import pandas as pd

        at = np.searchsorted(sent.value, keys.fillna(np.iinfo(np.int64).min).astype(np.int64), side="right")
        return pd.Series(at.astype(np.int32))

    rows = rows.withColumn("stretch", stretch("doc_id"))
    # One row for each stretch: the document that the stretch before it needs.
    low = F.min(F.coalesce("doc_id", F.lit(-(1 << 63))))
    heads = rows.select("doc_id", "stretch").groupBy("stretch").agg(low.alias("head"))
    before = F.coalesce(F.lag("stretch").over(W.orderBy("stretch")), F.max("stretch").over(W.partitionBy(F.lit(0))))
    # Twelve bytes for each STRETCH documents.
    table = F.broadcast(heads.select("head", before.alias("needed_by")))
    first = rows.join(table, F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("head")).groupBy("needed_by").agg(F.min("raw").alias("raw"))
    tails = first.select(F.lit(None).cast("bigint").alias("doc_id"), "raw", F.col("needed_by").alias("stretch"), F.lit(True).alias("tail"))
    dealt = rows.select("doc_id", "raw", "stretch", F.lit(False).alias("tail")).union(tails)
    dealt = dealt.repartition(len(marks) // 2 + 1, "stretch").sortWithinPartitions("stretch", "tail", F.asc_nulls_first("doc_id"), "raw")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures int"
    out = arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size, last, hashes = 0, None, anchors()
        for b in batches:
            for k in range(0, b.num_rows, 64):
                for doc, raw, tail in zip(*[c.to_pylist() for c in b.slice(k, 64).select([0, 1, 3]).columns]):
                    own = signatures(raw, CHAIN, hashes)
                    if last is not None:
                        done.append(_compare(*last, raw, own, hashes))
                        size += 16 * (len(last[2]) + len(own))
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
                            done, size = [], 0
                    last = None if tail else (doc, raw, own)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
        trim()

    return dealt.mapInArrow(run, schema)


def _compare(doc: int | None, text: str, own: np.ndarray, after: str, next_: np.ndarray, hashes: Hashes) -> tuple:
    n = len(text)
    k = n // 4
    edited = text[:n - k] + after[:k]
    new = own if edited == text else signatures(edited, CHAIN, hashes)
    return doc, n, hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(new), jaccard(own, new), jaccard(own, next_), len(own)
