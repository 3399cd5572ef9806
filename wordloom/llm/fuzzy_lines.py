"""Line deduplication by MinHash: one line stays of each group of fuzzy copies.

1. Lines are compared in lower case with white space collapsed.  Equal lines fold first, by a 128-bit hash.
2. Each distinct line's character shingles give a one-permutation MinHash of BANDS x ROWS values, and these a key
   for each band.  Lines of Jaccard 0.8 meet in one of 20 bands of 7 with probability 0.99, those of 0.9 with 0.99999, and
   those of 0.1 once in 500,000 pairs: with fewer rows the pairs that meet by chance would grow with the square of the table.
3. A changed letter alters as many shingles as they have characters, so short lines need short shingles: lines of
   LONG characters or more are compared with each other by shingles of SHINGLE, lines of fewer than SHORT by shingles of
   SHORT_SHINGLE.  Lines in between are compared in both ways, either may link them.  So are longer ones that repeat themselves: a line
   below LONG can be like one of SHORT or more only if that has FEW distinct short shingles at most.
4. In each band that several lines share, every line is paired with the band's first one, and the Jaccard index of
   the pair's whole shingle sets decides.  A distributed union-find joins what is linked.
5. Bands that still hold several components hold pairs that step 4 didn't compare: their lines are compared with all
   lines of other components, in blocks of bounded size.  So no link among a band's lines is lost, while copies that
   are linked already cost nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import Tables, cut, map_rows, pick, plain, tidy, trim
from wordloom.llm.set_links import set_classes

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 20, 7, 0.8
#: Lines of 49 characters still match their copy with a letter changed at SHINGLE; a line of 50 has no match below 41.
SHORT, LONG, SHORT_SHINGLE = 50, 40, 3
#: The most distinct short shingles that a match of a line below LONG has; and the characters by which most lines show that they have more.
FEW, GLANCE = int((LONG - SHORT_SHINGLE) / THRESHOLD), 96
#: Lines signed at once.
LINES = 2048
#: Code points hashed at once, and bits of the map of wanted places (8 MB).
WINDOW, MAP = 1 << 18, 1 << 26
#: Odd multipliers, and the mark of a cell without a shingle.
_SPREAD, _NONE = [pow(0x9E3779B1, i + 1, 1 << 32) for i in range(16)], np.uint32(0xFFFFFFFF)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _padded(line: str, k: int) -> str:
    return line if len(line) >= k else line + "\0" * (k - len(line))


def _hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k code points."""
    n = len(x) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= _P
        h += x[i:i + n]
    h ^= h >> np.uint64(29)
    h *= _Q
    h ^= h >> np.uint64(32)
    h *= _P
    return h


def _quick_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each run of k code points, for signatures."""
    n = len(x) - k + 1
    h = np.zeros(n, np.uint32)
    for i in range(k):
        h += x[i:i + n] * np.uint32(_SPREAD[i])
    for shift, times in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(times)
    h ^= h >> np.uint32(16)
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def shingles(line: str, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes, of 44 bits, of a line's runs of k code points; a shorter line is one shingle."""
    return np.unique(_hashes(_points(_padded(line, k)), k) >> np.uint64(20) << np.uint64(20))


def shingle_sets(lines: list[str], short: int) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of the lines' sets of shingles and, one after the other, their sorted distinct hashes, of 44 bits."""
    k = SHORT_SHINGLE if short else SHINGLE
    sizes: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= WINDOW):
            size += len(lines[end])
            end += 1
        padded = [_padded(x, k) for x in lines[at:end]]
        length = np.array([len(x) for x in padded])
        ends = np.cumsum(length)
        x = _hashes(_points("".join(padded)), k) >> np.uint64(20)
        x |= np.repeat(np.arange(len(padded), dtype=np.uint64) << np.uint64(44), length)[:len(x)]
        # Runs that go beyond a line's end are none.
        whole = np.ones(len(x), bool)
        beyond = (ends[:, None] - np.arange(1, k)).ravel()
        whole[beyond[beyond < len(x)]] = False
        x = x[whole]
        x.sort()
        x = x[np.r_[True, x[1:] != x[:-1]]]
        sizes.append(np.bincount((x >> np.uint64(44)).astype(np.int64), minlength=len(padded)))
        parts.append(x << np.uint64(20))
        at = end
    return np.concatenate(sizes) if sizes else np.zeros(0, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def repetitive(lines: list[str]) -> np.ndarray:
    """Which lines have FEW distinct short shingles at most; most lines show more in their first characters."""
    out = np.ones(len(lines), bool)
    for k in range(0, len(lines), LINES):
        some = [x[:GLANCE] for x in lines[k:k + LINES]]
        size = np.array([len(x) for x in some])
        x = np.zeros((len(some), GLANCE), np.uint32)
        x[np.arange(GLANCE) < size[:, None]] = _points("".join(some))
        runs = x[:, :-2].astype(np.uint64) << np.uint64(42) | x[:, 1:-1].astype(np.uint64) << np.uint64(21) | x[:, 2:]
        # Beyond a line's end all are alike.
        runs[np.arange(GLANCE - 2) >= np.maximum(size, 3)[:, None] - 2] = 0
        runs.sort(axis=1)
        out[k:k + LINES] = ((runs[:, 1:] != runs[:, :-1]) & (runs[:, 1:] > 0)).sum(axis=1) + (runs[:, 0] > 0) <= FEW
    for i in np.flatnonzero(out):
        out[i] = len(lines[i]) <= GLANCE or len(shingles(lines[i], SHORT_SHINGLE)) <= FEW
    return out


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> np.ndarray:
    """For each line a signed key for each band of its one-permutation MinHash.

    The hashes of many lines are taken at once, in windows that bound memory; a cell's value is the smallest hash that
    falls into it, and an empty cell takes the value of the first filled one among cells dealt to it at random (optimal
    densification: Shrivastava, 2017).
    """
    parts = [_some_band_keys(lines[i:i + LINES], bands, rows, k) for i in range(0, len(lines), LINES)]
    return np.vstack(parts) if parts else np.zeros((0, bands), np.int64)


@lru_cache(None)
def _donors(m: int, tries: int = 48) -> np.ndarray:
    """For each try the cells that m cells look into while they are empty, by a hash of both numbers."""
    x = np.arange(m * tries, dtype=np.uint64) * _P
    x ^= x >> np.uint64(31)
    x *= _Q
    return ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64).reshape(m, tries).T.copy()


def _some_band_keys(lines: list[str], bands: int, rows: int, k: int) -> np.ndarray:
    m = bands * rows
    padded = [_padded(x, k) for x in lines]
    sizes = np.array([len(x) for x in padded])
    ends = np.cumsum(sizes)
    x = _points("".join(padded))
    cells = np.full(len(lines) * m, _NONE)
    starts = ends - sizes
    for at in range(0, len(x) - k + 1, WINDOW):
        h = _quick_hashes(x[at:at + WINDOW + k - 1], k)
        # The lines in this window, how much of each is in it, and the runs that go beyond a line's end: all bits set, they are no minimum.
        low, high = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, at + len(h))
        here = np.minimum(ends[low:high], at + len(h)) - np.maximum(starts[low:high], at)
        beyond = (ends[low:high, None] - at - np.arange(1, k)).ravel()
        h[beyond[(beyond >= 0) & (beyond < len(h))]] = _NONE
        cell = np.repeat(np.arange(low, high) * m, here)
        cell += (h >> np.uint32(16)) * np.uint32(m) >> np.uint32(16)
        np.minimum.at(cells, cell, h)
    values = cells.astype(np.uint64)
    donors = _donors(m)
    marks = _Q * np.arange(1, len(donors) + 2, dtype=np.uint64)
    empty = np.flatnonzero(cells == _NONE)
    cell = empty % m
    for t, donor in enumerate(donors):
        got = cells.take(empty - cell + donor.take(cell))
        found = got != _NONE
        values[empty[found]] = got[found] + marks[t]
        empty, cell = empty[~found], cell[~found]
        if not len(empty):
            break
    if len(empty):
        # Few cells of these lines are filled; the first of them serves.
        line = empty // m
        values[empty] = cells[line * m + (cells.reshape(-1, m)[line] != _NONE).argmax(axis=1)].astype(np.uint64) + marks[-1]
    values = values.reshape(len(lines), m)
    # A band's cells are far apart, so that it doesn't take one donor for several of its rows.
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _Q, (len(lines), bands))
    for r in range(rows):
        keys = (keys ^ values[:, r * bands:(r + 1) * bands]) * _P
        keys = keys ^ (keys >> np.uint64(31))
    return keys.view(np.int64)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str | None) -> list[tuple[int, str]]:
    """The place (from 0) and normal form of each line that isn't blank; lines end at line feeds."""
    return [(i, n) for i, x in enumerate((text or "").split("\n")) if (n := normal(x))]


def _signed(rows: DataFrame, kind: str) -> DataFrame:
    """doc_id, line_no, h (128 bits) and keys of each line; keys are of one or both kinds, the lowest bit is set for short shingles."""

    schema = f"doc_id {kind}, line_no int, h binary, keys binary"
    names = ["doc_id", "line_no", "h", "keys"]

    def sign(docs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        found = [normal_lines(t) for t in texts.to_pylist()]
        lines = [n for some in found for _, n in some]
        of = np.repeat(np.arange(len(found)), [len(some) for some in found])
        size = np.array([len(x) for x in lines])
        # A line's keys follow each other, first those of long shingles.
        long, short = size >= LONG, size < SHORT
        beyond = np.flatnonzero(~short)
        short[beyond] = repetitive([lines[j] for j in beyond])
        ends = BANDS * np.cumsum(long.astype(np.int64) + short)
        keys = np.empty(int(ends[-1]) if len(lines) else 0, np.int64)
        for kind_, mine, start in ((0, long, ends - BANDS * (long.astype(np.int64) + short)), (1, short, ends - BANDS)):
            some = np.flatnonzero(mine)
            if len(some):
                got = band_keys([lines[j] for j in some], k=SHORT_SHINGLE if kind_ else SHINGLE) & ~1 | kind_
                keys[start[some][:, None] + np.arange(BANDS)] = got
        digests = b"".join([xxhash.xxh3_128_digest(n) for n in lines])
        offsets = (np.arange(len(lines) + 1) * 16).astype(np.int32)
        key_offsets = (8 * np.r_[0, ends]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                docs.take(pa.array(of)), pa.array(np.array([i for some in found for i, _ in some], np.int32)),
                pa.BinaryArray.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(offsets), pa.py_buffer(digests)]),
                pa.BinaryArray.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(key_offsets), pa.py_buffer(keys)]),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = 0
            while k < b.num_rows:
                n = min(256, b.num_rows - k)
                while n > 1 and b.slice(k, n).nbytes > 1 << 20:
                    n //= 2
                part = b.slice(k, n)
                k += n
                out = sign(part.column(0), part.column(1))
                if out.num_rows:
                    yield out
        trim()

    return rows.mapInArrow(run, schema)


#: Types of keys whose places are ordered as one number, and a number beyond all such keys.
_BEYOND = f"{1 << 64}BD"
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _place(kind: str) -> Column:
    """A line's place, ordered by doc_id and line_no; rows without a key come after all others.

    For integral keys one decimal, which hash aggregation takes, else a struct.
    """
    if kind in INTEGRAL:
        return (F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.expr(_BEYOND)) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(32,0)")
    return F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "line_no")


def _placed(place: str, kind: str) -> tuple[Column, Column]:
    """doc_id and line_no of a place."""
    if kind in INTEGRAL:
        line = F.pmod(F.col(place), F.lit(1 << 31).cast("decimal(32,0)"))
        doc = ((F.col(place) - line) / F.lit(1 << 31).cast("decimal(32,0)")).cast("decimal(22,0)")
        return F.when(doc < F.expr(_BEYOND), doc).cast(kind), line.cast("int")
    return F.col(f"{place}.doc_id"), F.col(f"{place}.line_no")


def _distinct(signed: DataFrame, kind: str) -> DataFrame:
    """Distinct lines: id, h, the smallest place, n and keys."""
    folded = signed.groupBy("h", "keys").agg(F.min(_place(kind)).alias("place"), F.count("*").alias("n"))
    return folded.select(F.monotonically_increasing_id().alias("id"), "h", "place", "n", "keys")


def _packed(rows: DataFrame) -> DataFrame:
    """Rows in compressed runs, one a row, for a checkpoint; ``_unpacked`` gives them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    return rows.mapInArrow(run, "rows binary")


def _unpacked(packed: DataFrame, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield from pa.ipc.open_stream(x.as_py())

    return packed.mapInArrow(run, schema)


def _bands(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ids of a batch of id and keys."""
    data = b.column(1).to_pylist()
    return np.frombuffer(b"".join(data), np.uint64), np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in data])


def _texts(rows: DataFrame, kind: str, wanted: DataFrame, tables: Tables) -> DataFrame:
    """h and data, the normal form, of the lines at wanted places (doc_id, line_no), and of few others.

    A bit map of the places' hashes, MAP bits however many there are, goes to all tasks and tells which lines to take.
    """

    def bit(doc: object, line: int) -> int:
        return xxhash.xxh64_intdigest(f"{doc}:{line}") % MAP

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MAP // 8, np.uint8)
        for b in batches:
            at = np.array([bit(d, i) for d, i in zip(*[c.to_pylist() for c in b.columns])], np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pages = bits.reshape(-1, 512)
        some = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([pages[i].tobytes() for i in some], pa.binary())], names=["page", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for page, data in zip(*[c.to_pylist() for c in b.columns]):
                x = np.frombuffer(data, np.uint8)
                found[page] = found[page] | x if page in found else x
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["page", "bits"])

    marked = wanted.select("doc_id", "line_no").mapInArrow(mark, "page bigint, bits binary").repartition("page").mapInArrow(unite, "page bigint, bits binary")
    bits = np.zeros((MAP // 8 // 512, 512), np.uint8)
    for r in marked.collect():
        bits[r.page] = np.frombuffer(r.bits, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits.tobytes())

    def start():
        seen = sent.value

        def f(docs: list, texts: list) -> list[tuple]:
            out = []
            for d, t in zip(docs, texts):
                for i, x in enumerate((t or "").split("\n")):
                    at = bit(d, i)
                    if seen[at >> 3] >> (at & 7) & 1 and (n := normal(x)):
                        out.append((xxhash.xxh3_128_digest(n), n))
            return out

        return f

    return tables.hold(map_rows(rows, "h binary, data string", start))


def _components(rows: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All lines' places (doc_id, line_no, h); and keep_doc_id, keep_line_no and n_copies for each h that isn't alone in its component."""
    spark = rows.sparkSession
    with Tables(spark) as tables, Tables(spark) as early:
        with Tables(spark) as first:
            signed = first.keep(_signed(rows, kind))
            bare = signed.drop("keys")
            places = _unpacked(cut(_packed(bare)), bare.schema)
            keyed = early.keep(_distinct(signed, kind))
        distinct = tables.keep(keyed.drop("keys"))
        tidy(rows)

        def source(ids: DataFrame) -> Callable[[DataFrame], DataFrame]:
            doc, line = _placed("place", kind)
            texts = _texts(rows, kind, ids.join(distinct, "id").select(doc.alias("doc_id"), line.alias("line_no")), tables)
            # A line that repeated rows hold comes back for each; its pairs are then compared again, to the same end.
            return lambda df: df.join(distinct.select("id", "h"), "id").join(texts, "h")

        roots = set_classes(keyed.select("id", "keys"), _bands, BANDS, source, shingle_sets, threshold, kinds=True, met=early.drop)
        tidy(rows)
        # Most lines are alone: only those with copies, fuzzy or not, have a row here.
        linked = roots.select("node", "root").union(roots.select("root", "root").distinct()).toDF("id", "root")
        named = tables.keep(distinct.select("id", "h", "n", "place").join(linked, "id", "left").where("root IS NOT NULL OR n > 1").select("h", "n", "place", F.coalesce("root", "id").alias("root")))
        heads = named.groupBy("root").agg(F.min("place").alias("keep"), F.sum("n").alias("n_copies"))
        doc, line = _placed("keep", kind)
        return places, cut(named.select("h", "root").join(heads, "root").select("h", doc.alias("keep_doc_id"), line.alias("keep_line_no"), "n_copies"))


def line_components(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each line that isn't blank: doc_id, line_no, keep_doc_id, keep_line_no, n_copies, kept.

    The first line of a component, by doc_id and then line_no, stays; n_copies counts all its lines.  Null and empty
    texts have no lines.  Rows without a key come after all others; lines of repeated rows at one place are one line, and
    all or none are kept.  An empty table gives no rows.
    """
    places, by_hash = _components(pick(df, key, text), dict(df.dtypes)[key], threshold)
    out = places.join(by_hash, "h", "left")
    keep_doc = F.when(F.col("n_copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_doc_id"))
    out = out.select("doc_id", "line_no", keep_doc.alias("keep_doc_id"), F.coalesce("keep_line_no", "line_no").alias("keep_line_no"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("line_no") == F.col("keep_line_no"))
    return out.withColumn("kept", kept)


def drop_lines(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, without the lines that don't stay; n_chars follows where it is a column.

    A row whose lines all go keeps an empty text.  Blank lines stay while a line of their text does.  Rows without a
    key stay as they are, null texts stay null.  Rows of one key lose lines alike, so repeated rows stay repeated.  An empty
    table stays empty; other columns, even ones whose names differ only in case, aren't touched.
    """
    places, by_hash = _components(pick(df, "doc_id", "text"), dict(df.dtypes)["doc_id"], threshold)
    gone = places.where("doc_id IS NOT NULL").join(by_hash, "h").where("NOT (keep_doc_id <=> doc_id AND keep_line_no = line_no)").select("doc_id", "line_no").distinct()
    gone = gone.groupBy("doc_id").agg(F.collect_list("line_no").alias("gone")).withColumnRenamed("doc_id", "gone_key")
    rows = plain(df)
    at, count = df.columns.index("text"), df.columns.index("n_chars") if "n_chars" in df.columns else None
    both = rows.join(gone, rows[f"c{df.columns.index('doc_id')}"] == gone["gone_key"], "left").drop("gone_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[:-1])
            texts, counts = [], columns[count].to_pylist() if count is not None else []
            for n, (t, lost) in enumerate(zip(columns[at], b.columns[-1])):
                t = t.as_py()
                if lost.is_valid and t is not None:
                    out = set(lost.as_py())
                    kept = [x for i, x in enumerate(t.split("\n")) if i not in out]
                    t = "\n".join(kept) if any(normal(x) for x in kept) else ""
                    if counts:
                        counts[n] = len(t)
                texts.append(t)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if counts:
                columns[count] = pa.array(counts, b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])
        trim()

    return both.mapInArrow(run, rows.schema).toDF(*df.columns)
