"""Helpers that the training-data operators share.

Every operator takes a DataFrame and names the columns it needs.  ``pick`` reads them by position, so other
columns, even ones whose names differ only in case, never clash with the operator's own.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.session import ship

#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def plain(df: DataFrame) -> DataFrame:
    """The frame with its columns named c0, c1 and so on."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first column of each name, whatever else the frame holds.  Every operator begins with it.

    It also sends the package along and, for the rest of the session, lowers Spark's usual bound of a batch to Python (``small_batches``); a session's own bound stays.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    at = [df.columns.index(n) for n in names]
    return plain(df).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


#: Spark's setting for the bytes of one batch on its way to Python, its default, and what the operators need.
BATCH, USUAL, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python in batches of a few MB, unless the session has a setting of its own.

    Texts are long: batches of the usual bytes take several times as many outside the heap, where no setting bounds them.
    """
    if spark.conf.get(BATCH, f"{USUAL}b").rstrip("bB") == str(USUAL):
        spark.conf.set(BATCH, str(SMALL))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names.

    A temporary one is taken only by a session on one machine that names none, as in tests; elsewhere that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wordloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    Files there outlive an executor, unlike a local checkpoint; Spark removes those of frames that are no longer in use
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate tables, gone when the block ends, for what is needed inside one step only; what a step returns must not read them.

    ``keep`` writes a table to the shared folder, columnar and compressed, which cuts its lineage: for what wouldn't come out
    the same a second time, such as numbers given to rows.  ``hold`` leaves the rest on the executors' disks and keeps its
    lineage: Spark makes the part of a lost executor anew.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/tables-{uuid4().hex}", 0
        self.held: list[DataFrame] = []

    def __enter__(self) -> Tables:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.option("compression", "zstd").parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        df.count()
        return df

    def drop(self) -> None:
        while self.held:
            self.held.pop().unpersist()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_: object) -> None:
        self.drop()


def tidy(df: DataFrame) -> None:
    """Lets go of the shuffle and checkpoint files of frames that are done with.

    Spark removes them when the driver's garbage collector finds their frames unused, by default every half hour; a chain of
    large steps would fill the disks by then.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def shared(df: DataFrame, value: object, make: Callable[[object], object]) -> Callable[[], object]:
    """Broadcasts a value of bounded size; the function returned gives, in a worker, what ``make`` makes of it there."""
    sent, key = df.sparkSession.sparkContext.broadcast(value), uuid4().hex
    return lambda: held(key, lambda: make(sent.value))


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so that no stage carries the tables of those before it."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def trim() -> None:
    """Gives memory that Python and Arrow have freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., list[tuple]]], rows: int = 256, most_bytes: int = 4 << 20) -> DataFrame:
    """Calls a function on small runs of rows.

    ``start`` runs once in each task and returns the function; that gets one list for each column and returns
    output rows.  Runs are of ``rows`` rows and ``most_bytes`` of data at most, so memory stays bounded however long texts are.
    """
    out = arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for b in batches:
            k = 0
            while k < b.num_rows:
                n = min(rows, b.num_rows - k)
                while n > 1 and b.slice(k, n).nbytes > most_bytes:
                    n //= 2
                part = b.slice(k, n)
                got = f(*[c.to_pylist() for c in part.columns])
                k += n
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*got), out)], schema=out)
        trim()

    return df.mapInArrow(run, schema)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))
