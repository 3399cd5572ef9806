"""A completion trie: for every prefix its best words, made from the bottom up."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.relational import top_k
from wordloom.session import ship

#: Longest prefix that is a node.
LONGEST = 12
_ROW = "prefix string, open boolean, words array<struct<weight:double,size:int,norm:string,word:string,own:boolean>>"


def completions(table: DataFrame, k: int, exact_first: bool = False, longest: int = LONGEST) -> DataFrame:
    """prefix, word, place: the k best words of every prefix of a norm, up to ``longest`` characters (SRT-01, SRT-02, LKP-18).

    table: word, norm and weight; the smallest weight is best, none comes last, then the shorter word, by norm and word.  With ``exact_first`` words whose norm is
    the prefix itself lead.  Empty and null norms are no one's completion; equal rows count each.

    Rows are range-partitioned and sorted by norm, and a task goes through its rows once with the nodes of the last norm's prefixes at hand: a word enters
    the node of its longest prefix alone, and a node that is left hands its k best on to its parent.  Nodes that may reach over tasks, those of
    a task's first and last norm, are merged afterwards.
    """
    ship(table.sparkSession)
    rows = table.where("norm <> ''").select("norm", "word", F.coalesce(F.col("weight").cast("double"), F.lit(float("inf"))).alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, out = None, "", []
        # For each length of prefix the node's words that end there, and its best.
        nodes: list[tuple[list, list]] = []

        def leave(depth: int) -> None:
            """Hands on the nodes of prefixes longer than ``depth``."""
            while len(nodes) > depth:
                own, best = nodes.pop()
                prefix = last[:len(nodes) + 1]
                if nodes:
                    nodes[-1][1][:] = heapq.nsmallest(k, nodes[-1][1] + best)
                ends = set(map(id, own))
                lead = own if exact_first else []
                words = [(*x, True) for x in lead] + [(*x, False) for x in best if not exact_first or id(x) not in ends]
                out.append((prefix, first.startswith(prefix), words))

        def rows_out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), pa.array([[dict(zip(("weight", "size", "norm", "word", "own"), w)) for w in x[2]] for x in out], types)], names=["prefix", "open", "words"])
            out.clear()
            return got

        types = pa.list_(pa.struct([("weight", pa.float64()), ("size", pa.int32()), ("norm", pa.string()), ("word", pa.string()), ("own", pa.bool_())]))
        for b in batches:
            for norm, word, weight in zip(*[c.to_pylist() for c in b.columns]):
                first = norm if first is None else first
                here = norm[:longest]
                same = 0
                while same < min(len(here), len(last)) and here[same] == last[same]:
                    same += 1
                leave(same)
                last = here
                while len(nodes) < len(here):
                    nodes.append(([], []))
                own, best = nodes[-1]
                x = (weight, len(word), norm, word)
                best.append(x)
                best[:] = heapq.nsmallest(k, best)
                if len(norm) <= longest:
                    own.append(x)
                    own[:] = heapq.nsmallest(k, own)
            if len(out) > 4096:
                yield rows_out()
        # The last norm's prefixes may go on in the next task.
        done = len(out)
        leave(0)
        out[done:] = [(p, True, w) for p, _, w in out[done:]]
        if out:
            yield rows_out()

    found = rows.repartitionByRange("norm").sortWithinPartitions("norm").mapInArrow(run, _ROW)
    words = found.select("prefix", "open", F.posexplode("words").alias("at", "w")).select("prefix", "open", "at", "w.*")
    order = [F.desc("own"), F.asc("weight"), F.asc("size"), F.asc("norm"), F.asc("word")]
    merged = top_k(words.where("open"), ["prefix"], order, k, "place").select("prefix", "word", "place")
    return words.where((~F.col("open")) & (F.col("at") < k)).select("prefix", "word", (F.col("at") + 1).alias("place")).unionByName(merged)


def complete(queries: DataFrame, table: DataFrame, k: int, exact_first: bool = False, longest: int = LONGEST) -> DataFrame:
    """q, word, place: FLT-20: the k best words whose norm starts with each query; a query longer than the trie is deep meets words by its first characters."""
    asked = queries.select("q").where("q <> ''").distinct()
    short = asked.where(F.length("q") <= longest).withColumnRenamed("q", "prefix").join(completions(table, k, exact_first, longest), "prefix").select(F.col("prefix").alias("q"), "word", "place")
    start = lambda c: F.substring(c, 1, longest).alias("_start")
    both = asked.where(F.length("q") > longest).select("q", start("q")).join(table.where(F.length("norm") > longest).select("*", start("norm")), "_start").where(F.col("norm").startswith(F.col("q")))
    exact = [F.desc(F.col("norm") == F.col("q"))] if exact_first else []
    long = top_k(both, ["q"], [*exact, F.asc_nulls_last("weight"), F.length("word"), F.asc("norm"), F.asc("word")], k, "place").select("q", "word", "place")
    return short.unionByName(long)
