"""Coverage metrics, gates and invariants; ranges of sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a release must reach, in per cent.
GATE = {"entry": 98.0, "definition": 98.0, "ipa": 95.0, "example": 90.0, "vi": 85.0}


def coverage(words: DataFrame, entry: DataFrame, pronunciation: DataFrame, sense: DataFrame, example: DataFrame, vi_block: DataFrame) -> DataFrame:
    """AGG-11, JOIN-01..03, MTH-10: metric and pct over the top words (column word).

    Each metric is one semi-join of the words with the entries that have something; all run in one job.
    """
    hw = entry.select("id", F.col("headword").alias("word"))
    having = lambda df, on: hw.join(df.select(F.col(on).alias("id")).distinct(), "id", "left_semi")
    sensed = sense.where("definition <> ''")
    vi_any = having(vi_block, "entry_id").unionByName(having(sense.where("vi IS NOT NULL"), "entry_id"))
    parts = {
        "entry": hw, "definition": having(sensed, "entry_id"), "ipa": having(pronunciation, "entry_id"),
        "example": having(sense.join(example.select(F.col("sense_id").alias("id")).distinct(), "id", "left_semi"), "entry_id"), "vi": vi_any,
    }
    total = words.select("word").distinct()
    out = None
    for name, df in parts.items():
        row = total.join(df.select("word", F.lit(1).alias("_has")).distinct(), "word", "left").agg(F.lit(name).alias("metric"), F.round(100 * F.count("_has") / F.count("*"), 1).alias("pct"))
        out = row if out is None else out.unionByName(row)
    return out


def gate(metrics: DataFrame, thresholds: dict[str, float] = GATE) -> DataFrame:
    """AGG-22, VAR-23: metric, pct, least, ok; a metric that isn't there fails."""
    least = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))])
    want = metrics.sparkSession.createDataFrame([(k,) for k in thresholds], "metric string")
    return want.join(metrics, "metric", "left").select("metric", "pct", least[F.col("metric")].alias("least"), F.coalesce(F.col("pct") >= least[F.col("metric")], F.lit(False)).alias("ok"))


def assert_gate(metrics: DataFrame, thresholds: dict[str, float] = GATE) -> None:
    failed = gate(metrics, thresholds).where("NOT ok").collect()
    if failed:
        raise ValueError("below the gate: " + ", ".join(f"{r.metric} {r.pct} < {r.least}" for r in failed))


def invariants(sense: DataFrame, entry: DataFrame, example: DataFrame, source: DataFrame) -> DataFrame:
    """VAR-24: counts that must be 0."""
    ai = sense.where("is_ai").join(entry.where("ai_model IS NULL").select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    full = example.where("is_ai").join(sense.where("layer <> 'learner'").select(F.col("id").alias("sense_id")), "sense_id", "left_semi")
    bare = source.where("coalesce(license, '') = ''")
    count = lambda df, name: df.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
    return count(ai, "ai sense without model").unionByName(count(full, "ai example outside the learner layer")).unionByName(count(bare, "source without licence"))


#: A quantile sketch's rank is off by the 1 / ACCURACY of a group's rows at most.
ACCURACY = 10_000


def sizes(df: DataFrame, by: list[str], size: str, points: tuple[float, ...] = (0.5, 0.95), accuracy: int = ACCURACY) -> DataFrame:
    """AGG-21, VAR-21, VAR-22: count, sum, nearest-rank percentiles and maximum; null sizes count as rows and have no rank.

    A mergeable sketch of bounded size gives each percentile a bracket that is sure to hold it; then values inside it are counted exactly, a row for each of them,
    and those below as one number.  So no task holds a group's values.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(size).alias("_v"))
    off = 2 / accuracy
    # Ends of the range are exact by themselves.
    end = lambda q, worst: worst("_v") if not 0 < q < 1 else F.percentile_approx("_v", float(q), accuracy)
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("_v").alias("_m"), F.sum("_v").alias("total"), F.max("_v").alias("most"),
        *[F.struct(end(p - off, F.min).alias("low"), end(p + off, F.max).alias("high")).alias(f"_b{i}") for i, p in enumerate(points)],
    )
    out = groups
    for i, p in enumerate(points):
        bracket = groups.select(*keys, "_m", f"_b{i}")
        both = rows.join(bracket.withColumnsRenamed({k: f"_{k}" for k in keys}), [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys] or F.lit(True)).where((F.col("_v") <= F.col(f"_b{i}.high")))
        inside = F.when(F.col("_v") >= F.col(f"_b{i}.low"), F.col("_v"))
        counted = both.groupBy(*keys, "_m", inside.alias("_v")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
        found = counted.withColumn("_upto", upto).where((F.col("_upto") >= F.ceil(F.lit(p) * F.col("_m"))) & F.col("_v").isNotNull()).groupBy(*keys).agg(F.min("_v").alias(f"p{round(100 * p)}"))
        out = out.join(found.withColumnsRenamed({k: f"_{k}" for k in keys}), [out[k].eqNullSafe(F.col(f"_{k}")) for k in keys] or F.lit(True), "left").drop(*[f"_{k}" for k in keys])
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", "total", *[f"p{round(100 * p)}" for p in points], "most")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-12, LKP-11."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def stored_bytes(text: Column, overhead: int = 30) -> Column:
    """AGG-29."""
    return F.sum(F.octet_length(text) + overhead)


def role_coverage(examples: DataFrame, wanted: DataFrame, least: int = 2) -> DataFrame:
    """AGG-28: for each part of speech the words with ``least`` examples in every main role, and all words.

    wanted: pos, role.
    """
    nodes = examples.select("lemma", "pos").distinct().join(wanted, "pos")
    counts = examples.groupBy("lemma", "pos", "role").agg(F.count("*").alias("n"))
    per = nodes.join(counts, ["lemma", "pos", "role"], "left").groupBy("lemma", "pos").agg(F.bool_and(F.coalesce("n", F.lit(0)) >= least).alias("full"))
    return per.groupBy("pos").agg(F.count_if("full").alias("full"), F.count("*").alias("words"))
