"""Packing words into batches in order: sequential state, taken chunk by chunk (BAT-05, BAT-06)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.relational import rank_within
from wordloom.operators.tables import cut
from wordloom.session import ship

#: Places of a class that one task walks.
CHUNK = 50_000


def _starts(cost: list[int], own: int, at: int, most_words: int, most_cost: int) -> tuple[list[int], int]:
    """Where batches begin that follow each other from ``at`` on, as far as the first ``own`` words, and the place after the last one."""
    out = []
    while at < own:
        out.append(at)
        n, total = 0, 0
        while at < len(cost) and n < most_words and (not n or total + cost[at] <= most_cost):
            n, total, at = n + 1, total + cost[at], at + 1
    return out, at


def _composed(maps: DataFrame, by: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each chunk's map put after those of all chunks before it, in as many rounds as the logarithm of their number.

    maps: the class, _chunk, and for each place where a batch may begin n, the batches begun in the chunk, and after, where the next one begins in the chunk after it.  In round k a
    chunk's map goes over the last 2 ** k chunks, and meets that of the chunk 2 ** k before.
    """
    far, most = 1, maps.agg(F.max("_chunk")).first()[0] or 0
    while far <= most:
        back = maps.select(by, (F.col("_chunk") + far).alias("_chunk"), F.col("n").alias("_n"), F.col("after").alias("_after"))
        both = maps.join(back, [by, "_chunk"], "left")
        at = lambda c: F.transform("_after", lambda x: F.get(F.col(c), x))
        n = F.when(F.col("_after").isNull(), F.col("n")).otherwise(F.zip_with("_n", at("n"), lambda x, y: x + y))
        maps = cut(both.select(by, "_chunk", n.alias("n"), F.when(F.col("_after").isNull(), F.col("after")).otherwise(at("after")).alias("after")))
        far *= 2
    return maps


def next_fit(df: DataFrame, by: str, most_words: dict[str, int], most_cost: dict[str, int], chunk: int = CHUNK) -> DataFrame:
    """BAT-05, BAT-06: adds batch, numbered in each class in order of ``place``: a batch closes when a word would exceed its words or cost.

    rows: place, word, cost and the class column.  A batch holds ``most_words`` at most, so the first batch of a chunk begins at one
    of its first places: each chunk, with as many places of the next one, is walked from all of them at once, which makes a map from where
    its first batch begins to where the next chunk's does.  Maps are composed by a parallel prefix scan on the cluster, and each chunk is then walked from the place that is right.
    """
    ship(df.sparkSession)
    kinds = list(most_words)
    # A batch reaches into the next chunk at most.
    chunk = max(chunk, *most_words.values())
    limit = F.create_map(*[F.lit(x) for k in kinds for x in (k, most_words[k])])
    placed = rank_within(df, [by], [F.asc("place")], "_n").withColumn("_chunk", F.floor(F.col("_n") / chunk)).withColumn("_i", F.col("_n") % chunk)
    ahead = placed.where((F.col("_chunk") > 0) & (F.col("_i") < limit[F.col(by)])).withColumn("_chunk", F.col("_chunk") - 1).withColumn("_i", F.col("_i") + chunk)
    walked = placed.select(by, "_chunk", "_i", "cost").union(ahead.select(by, "_chunk", "_i", "cost"))
    kind_type = dict(df.dtypes)[by]

    def walks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        kind, cost = pdf[by].iloc[0], pdf["cost"].tolist()
        own = int((pdf["_i"] < chunk).sum())
        n, after = [], []
        for at in range(most_words[kind]):
            # A batch that covers a chunk's whole rest begins none there.
            starts, end = _starts(cost, own, at, most_words[kind], most_cost[kind]) if at < own else ([], at)
            n.append(len(starts))
            after.append(end - own)
        return pd.DataFrame({by: [kind], "_chunk": [int(pdf["_chunk"].iloc[0])], "n": [n], "after": [after]})

    maps = cut(walked.groupBy(by, "_chunk").applyInPandas(walks, f"{by} {kind_type}, _chunk bigint, n array<bigint>, after array<int>"))
    # What a class's first chunks, from place 0 on, hand over to the next one.
    ends = _composed(maps, by, cut).select(by, (F.col("_chunk") + 1).alias("_chunk"), F.col("after")[0].alias("_at"), F.col("n")[0].alias("_batch"))
    first = placed.join(ends, [by, "_chunk"], "left").withColumn("_at", F.coalesce("_at", F.lit(0))).withColumn("_batch", F.coalesce("_batch", F.lit(0)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", batch int"
    names = df.columns

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        kind, at, batch = pdf[by].iloc[0], int(pdf["_at"].iloc[0]), int(pdf["_batch"].iloc[0])
        starts, _ = _starts(pdf["cost"].tolist(), len(pdf), at, most_words[kind], most_cost[kind])
        begun = pd.Series(0, index=range(len(pdf)))
        begun.iloc[starts] = 1
        return pdf[names].assign(batch=(begun.cumsum() + batch - 1).astype("int32").tolist())

    return first.groupBy(by, "_chunk").applyInPandas(number, schema)


def plan(words: DataFrame, version: str, models: dict[str, str], most_words: dict[str, int], most_cost: dict[str, int], hard: int = 12) -> DataFrame:
    """BAT-05, MTH-09: batches by difficulty: id, model, words, rank_first; words: place, word, cost (senses).  Words without senses are left out."""
    classed = words.where("cost > 0").withColumn("kind", F.when(F.col("cost") >= hard, "medium").otherwise("low"))
    packed = next_fit(classed, "kind", most_words, most_cost)
    rows = packed.groupBy("kind", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("words"), F.min("place").alias("rank_first"))
    model = T.recode("kind", models)
    return rows.select(T.batch_id(version, model, F.col("words")).alias("id"), model.alias("model"), "words", "rank_first")


def planned_words(batches: DataFrame) -> DataFrame:
    """BAT-12: words of a plan in rank order."""
    return batches.select("rank_first", F.posexplode("words").alias("at", "word"))


def pending(failed: DataFrame, done: DataFrame) -> DataFrame:
    """BAT-10, VAR-46."""
    return failed.join(done, "id", "left_anti")


def gaps(sent: DataFrame, answered: DataFrame) -> DataFrame:
    """JOIN-25: (word, pos) whose senses weren't all answered; both: word, pos, n."""
    got = answered.select("word", "pos", F.col("n").alias("answered"))
    return sent.join(got, ["word", "pos"], "left").withColumn("answered", F.coalesce("answered", F.lit(0))).where("answered < n")
