"""Product codes of vectors: one codebook for each part of a vector, fitted by Elkan's variant of Lloyd's rounds (2003).

Components are integers, so that sums, distances and ties are exact however rows are dealt out.  Between rounds each row keeps, for each
part, an upper bound of the distance to its entry and one lower bound for each entry.  When entries move, bounds shift by as much; an entry whose lower bound, or half
of whose distance to the row's entry, is strictly above the upper bound can be neither nearer nor as near, and is left out.  What is
left is measured in integers, which also settles ties.  Bounds are rounded outwards, an entry's lower bound to one byte of its part's scale.

A round is one pass over the rows, which writes the new bounds; sums and counts of entries are added up inside tasks and once more on the cluster,
and the driver sees codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import Tables, arrow_schema, cut, pick, trim

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a greater size would overflow 64-bit sums of squares.
MOST = 1 << 26
#: Rows worked on at once.
ROWS = 1024
#: A bound is pushed outwards by this share of it, and kept in single precision.
SLACK = 1e-6


def finite(vector: str) -> Column:
    """Vectors with components, all of them finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def whole_numbers(df: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and ints, the components floor(scale * x) as packed 32-bit integers, of the rows that ``finite`` keeps."""
    rows = df.where(finite("embedding")).select("vec_id", "label", "embedding")
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("ints", T.BinaryType())])
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                vectors = part.column(2)
                x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if len(x) and np.abs(x).max() >= MOST:
                    raise ValueError(f"components beyond {MOST / scale} overflow the sums of squares")
                ends = np.r_[0, np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))] * 4
                data = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x.astype(np.int32))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), data], schema=out)

    return rows.mapInArrow(run, schema)


def squares(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of rows' parts (rows, parts, width) to all entries (parts, entries, width)."""
    d = np.zeros((*x.shape[:2], books.shape[1]), np.int64)
    for w in range(x.shape[2]):
        step = x[:, :, w, None].astype(np.int64) - books[None, :, :, w]
        d += step * step
    return d


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf)), 0)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each part's nearest entry, ties to the lower index, by all distances; and the bounds, which begin as these."""
    d = squares(x, books)
    best = d.argmin(axis=2)
    root = np.sqrt(d)
    return best, up(np.take_along_axis(root, best[:, :, None], 2)[:, :, 0]), down(root)


def reassign(x: np.ndarray, books: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries have moved by ``moved`` (parts, entries), by the distances alone that the bounds leave open; and how many these were."""
    parts = np.arange(x.shape[1])
    upper = up(upper.astype(np.float64) + moved[parts, best])
    lower = down(np.maximum(lower.astype(np.float64) - moved, 0))
    half = down(np.sqrt(np.stack([squares(b[:, None], b[None])[:, 0] for b in books])) / 2)
    # Strictly beyond: an entry that may be as near stays open, as its index may be lower.
    open_ = (lower <= upper[:, :, None]) & (half[parts, best] <= upper[:, :, None])
    np.put_along_axis(open_, best[:, :, None], True, 2)
    some = open_.sum(axis=2) > 1
    open_ &= some[:, :, None]
    i, p, e = np.nonzero(open_)
    step = x[i, p] - books[p, e]
    d = np.full(open_.shape, np.iinfo(np.int64).max)
    d[i, p, e] = (step * step).sum(axis=1)
    new = np.where(some, d.argmin(axis=2), best)
    root = np.sqrt(d[i, p, e])
    lower[i, p, e] = down(root)
    nearest = np.take_along_axis(d, new[:, :, None], 2)[:, :, 0]
    return new, np.where(some, up(np.sqrt(np.where(some, nearest, 0))), upper), lower, len(i)


def narrow(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as one byte each, and the scale of each part; never above what they were."""
    scale = up(lower.max(axis=2) / 255)
    return np.floor(lower / scale[:, :, None] * (1 - SLACK)).astype(np.uint8), scale


def _mapped(rows: DataFrame, schema: T.StructType, f: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays(f(b.slice(k, ROWS)), schema=out)
        trim()

    return rows.mapInArrow(run, schema)


def _flat(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floor of its parts' mean; unused entries stay.

    A task sends on one row of sums for each entry that it met, and a row for each entry comes to the driver.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            x, best = _flat(b.column(0), np.int32, parts, width), _flat(b.column(1), np.uint8, parts)
            at = (best + np.arange(parts) * entries).ravel()
            n += np.bincount(at, minlength=len(n))
            np.add.at(total, at, x.reshape(-1, width))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(n[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], names=["at", "n", "total"])

    sums = rows.select("ints", "best").mapInArrow(run, "at bigint, n bigint, total array<bigint>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    each = sums.groupBy("at").agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.col("total")[w]) for w in range(width)]).alias("total"))
    out = books.copy()
    for r in each.collect():
        out[r["at"] // entries, r["at"] % entries] = [int(t) // int(r.n) for t in r.total]
    return out


def fit_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, watch: Callable[[int, int], None] | None = None) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (one byte a part) and error of each vector kept, in a frame that is written already; and the codebooks (part, entry, component).

    Vectors that are null or empty, or hold null or non-finite components, are dropped.  All others must have one length that ``parts`` divides, and components below
    MOST / scale; else it raises.  Codebooks begin as the parts of the ``entries`` smallest keys (of equal keys the smaller
    vector first, rows without a key last); fewer rows make fewer entries, none none.  Repeated rows count each.  ``watch`` gets the numbers of distances that the bounds left open and of all, after each
    round but the first; it costs a pass.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    rows = pick(df, key, vector, label).toDF("vec_id", "embedding", "label")
    with Tables(df.sparkSession) as tables:
        held = tables.keep(whole_numbers(rows, scale))
        sizes = held.agg(F.min(F.length("ints")), F.max(F.length("ints"))).first()
        if sizes[0] is None:
            schema = T.StructType([held.schema["vec_id"], held.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
            return df.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
        if sizes[0] != sizes[1] or sizes[0] // 4 % parts:
            raise ValueError(f"vectors of {sizes[0] // 4} to {sizes[1] // 4} components can't be cut into {parts} equal parts")
        width = sizes[0] // 4 // parts
        # Equal keys: by the vector, read as numbers.
        first = rows.where(finite("embedding")).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
        seeds = [np.floor(np.array(r.embedding, np.float64) * scale).astype(np.int64) for r in first]
        books = np.stack(seeds).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
        state = T.StructType([*held.schema, *[T.StructField(c, T.BinaryType()) for c in ("best", "upper", "scale", "lower")], T.StructField("open", T.LongType())])

        def kept(b: pa.RecordBatch, best: np.ndarray, upper: np.ndarray, lower: np.ndarray, n: int) -> list[pa.Array]:
            small, unit = narrow(lower)
            return [*b.columns[:3], *map(_packed, (best.astype(np.uint8), upper, unit, small)), pa.array([n] + [0] * (len(b) - 1), pa.int64())]

        def begin(b: pa.RecordBatch) -> list[pa.Array]:
            return kept(b, *assign(_flat(b.column(2), np.int32, parts, width), books), 0)

        def renewed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
            x, best, upper, unit = (_flat(b.column(k), t, parts, *more) for k, t, more in ((2, np.int32, (width,)), (3, np.uint8, ()), (4, np.float32, ()), (5, np.float32, ())))
            lower = _flat(b.column(6), np.uint8, parts, books.shape[1]) * unit[:, :, None].astype(np.float64) * (1 - SLACK)
            return reassign(x.astype(np.int64), books, best.astype(np.int64), upper, lower, moved)

        def again(b: pa.RecordBatch) -> list[pa.Array]:
            return kept(b, *renewed(b))

        def final(b: pa.RecordBatch) -> list[pa.Array]:
            best = renewed(b)[0]
            step = _flat(b.column(2), np.int32, parts, width) - books[np.arange(parts), best]
            return [b.column(0), b.column(1), _packed(best.astype(np.uint8)), pa.array((step * step).sum(axis=(1, 2)))]

        moved, last = np.zeros(books.shape[:2]), Tables(df.sparkSession)
        now = last.keep(_mapped(held, state, begin))
        try:
            for r in range(rounds):
                if r:
                    old, last = last, Tables(df.sparkSession)
                    now = last.keep(_mapped(now, state, again))
                    old.drop()
                    if watch:
                        watch(*now.agg(F.sum("open"), F.count("*") * parts * books.shape[1]).first())
                new = _moved(now, books)
                moved, books = np.sqrt(((new - books) ** 2).sum(axis=2)), new
            coded = T.StructType([*held.schema[:2], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
            return cut(_mapped(now, coded, final)), books
        finally:
            last.drop()


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **how: int) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together) and codebooks_sha256, one row for each vector kept.

    What ``fit_codes`` says of nulls, repeats, ties and empty tables holds here.
    """
    codes, books = fit_codes(df, key, vector, label, **how)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # A row for each label; labels are added up in tasks first, and the join is one that Spark may split.
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    both = codes.join(sums, codes["label"].eqNullSafe(sums["_label"]))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
