"""Many phrases in many sentences at once: an Aho-Corasick automaton over words (1975)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import ship

#: Characters of phrases that one automaton holds; a larger set is split by the phrases' first words, into PASSES parts at most.
MOST, PASSES = 8_000_000, 8


@dataclass
class Automaton:
    """For each state the next states by word, the state of its longest proper suffix, and the phrases that end there."""

    goto: list[dict[str, int]] = field(default_factory=lambda: [{}])
    fail: list[int] = field(default_factory=lambda: [0])
    ends: list[tuple[int, ...]] = field(default_factory=lambda: [()])

    def found(self, words: list[str]) -> set[int]:
        state, out = 0, set()
        for w in words:
            while state and w not in self.goto[state]:
                state = self.fail[state]
            state = self.goto[state].get(w, 0)
            out.update(self.ends[state])
        return out


def automaton(phrases: list[list[str]]) -> Automaton:
    """Of phrases as lists of words, told apart by their places; empty ones are never found."""
    a = Automaton()
    for n, phrase in enumerate(phrases):
        state = 0
        for w in phrase:
            if w not in a.goto[state]:
                a.goto[state][w] = len(a.goto)
                a.goto.append({})
                a.fail.append(0)
                a.ends.append(())
            state = a.goto[state][w]
        if phrase:
            a.ends[state] += (n,)
    # By depth, so that a state's suffixes are done before it.
    row = list(a.goto[0].values())
    while row:
        after = []
        for state in row:
            for w, to in a.goto[state].items():
                back = a.fail[state]
                while back and w not in a.goto[back]:
                    back = a.fail[back]
                a.fail[to] = a.goto[back].get(w, 0)
                a.ends[to] += a.ends[a.fail[to]]
                after.append(to)
        row = after
    return a


def phrase_hits(sentences: DataFrame, phrases: DataFrame, carry: list[str], most: int = MOST) -> DataFrame:
    """phrase and ``carry``: each sentence (words, an array, and the columns carried) with the phrases that it holds as whole words, each once.

    Phrases are of words with single spaces.  They come to the driver for an automaton of ``most`` characters at most; a larger set is split by
    first words, a pass over the sentences for each part, and one beyond PASSES parts meets the sentences' runs of words in an equi-join.
    """
    ship(sentences.sparkSession)
    spark = sentences.sparkSession
    wanted = phrases.select("phrase").where("phrase <> ''").distinct().withColumn("_words", F.split("phrase", " "))
    size, longest = wanted.agg(F.sum(F.length("phrase")), F.max(F.size("_words"))).first()
    if size is None:
        return sentences.select(F.lit("").alias("phrase"), *carry).limit(0)
    parts = -(-size // most)
    if parts > PASSES:
        runs = lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))
        some = sentences.select(F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, longest + 1)])))).alias("phrase"), *carry)
        return some.join(wanted.select("phrase"), "phrase").select("phrase", *carry)
    schema = f"_n bigint, {', '.join(f'`{c}` {t}' for c, t in sentences.select(*carry).dtypes)}"
    out = None
    for part in range(parts):
        mine = sorted(r.phrase for r in wanted.where(F.pmod(F.xxhash64(F.col("_words")[0]), F.lit(parts)) == part).collect())
        sent = spark.sparkContext.broadcast(automaton([p.split(" ") for p in mine]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            a = sent.value
            for b in batches:
                hits = [(i, n) for i, words in enumerate(b.column(0).to_pylist()) if words for n in sorted(a.found(words))]
                if hits:
                    row, n = map(np.array, zip(*hits))
                    yield pa.RecordBatch.from_arrays([pa.array(n), *[c.take(pa.array(row)) for c in b.columns[1:]]], names=["_n", *carry])

        names = spark.createDataFrame(list(enumerate(mine)), "_n bigint, phrase string")
        found = sentences.select("words", *carry).mapInArrow(run, schema).join(names, "_n").select("phrase", *carry)
        out = found if out is None else out.unionByName(found)
    return out
