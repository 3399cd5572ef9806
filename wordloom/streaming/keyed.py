"""A user's history as keyed state of a stream: a map from key to last visit, which timers expire (USR-01, USR-02)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wordloom.session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VISIT = "user_id bigint, key string, label string, ts timestamp, id bigint, visits bigint"


class Visits(StatefulProcessor):
    """For each user the last visit of each key and how many there were; a key that is idle for ``keep`` seconds of event time goes."""

    def __init__(self, keep: int | None = None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "key string", "label string, ts bigint, id bigint, visits bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        changed: dict[str, tuple] = {}
        for df in rows:
            for name, label, ts, id_ in zip(df["key"], df["label"], df["ts"], df["id"]):
                at = int(pd.Timestamp(ts).value // 1000)
                if name not in changed:
                    had = self.last.getValue((name,))
                    changed[name] = (label, -(1 << 62), -1, 0) if had is None else tuple(had)
                old = changed[name]
                new = (label, at, int(id_)) if (at, int(id_)) > (old[1], old[2]) else old[:3]
                changed[name] = (*new, old[3] + 1)
        for name, value in changed.items():
            self.last.updateValue((name,), value)
        if self.keep is not None and changed:
            self.handle.registerTimer(max(v[1] for v in changed.values()) // 1000 + 1000 * self.keep)
        if changed:
            yield pd.DataFrame([(key[0], k, v[0], pd.Timestamp(v[1], unit="us"), v[2], v[3]) for k, v in changed.items()], columns=["user_id", "key", "label", "ts", "id", "visits"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        for (name,), value in list(self.last.iterator()):
            if value[1] // 1000 + 1000 * self.keep <= due:
                self.last.removeKey((name,))
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state lives in RocksDB; the session's own setting comes back."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old) if old else spark.conf.unset(_PROVIDER)


def last_visits(stream: DataFrame) -> DataFrame:
    """What ``Visits`` keeps where no key expires: an aggregate of Spark's own, whose state is a row a key and never leaves the store's side."""
    last = F.max(F.struct("ts", "id", "label"))
    return stream.groupBy("user_id", "key").agg(last.alias("last"), F.count("*").alias("visits")).select("user_id", "key", "last.label", "last.ts", "last.id", "visits")


def follow(stream: DataFrame, path: str, checkpoint: str, keep: int | None = None, late: str = "1 hour") -> None:
    """Takes what a stream of visits (user_id, key, label, ts, id) has now, and appends each key's new last visit to the table under ``path``.

    A micro-batch reads and writes the state of its own keys only, and appends what changed under its own number, so a batch that runs again replaces its own rows; started again with
    its checkpoint it goes on.  With ``keep``, which needs timers and so a processor of a user's keys in Python, keys that are idle for so many seconds begin anew, and visits later than ``late`` are out.
    """
    spark = stream.sparkSession
    if keep is None:
        visits = last_visits(stream)
    else:
        ship(spark)
        visits = stream.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Visits(keep), outputStructType=VISIT, outputMode="Update", timeMode="EventTime")

    def append(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    with _rocks(spark):
        visits.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def history(spark: SparkSession, path: str) -> DataFrame:
    """USR-02: each user's keys with their last visit and number of visits, from what ``follow`` appended."""
    rows = spark.read.schema(f"{VISIT}, batch bigint").parquet(path)
    newest = rows.withColumn("_n", F.row_number().over(W.partitionBy("user_id", "key").orderBy(F.desc("batch")))).where("_n = 1")
    return newest.drop("_n", "batch")
