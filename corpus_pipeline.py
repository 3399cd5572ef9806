"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents, whatever others there are, even ones whose names differ only in case.  An empty table goes through
all stages empty.  Repeated rows share one fate, and equal scores or sizes are settled by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import fuzzy_lines, langid, packing, secret_grammar, simhash
from wordloom.llm.common import Tables, cut
from wordloom.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go, null, empty and letterless texts among them; a missing language is filled in.  A null key stays."""
    return langid.keep_known(docs, langid.fit(langid.held_out_split(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line stays of each group of fuzzy copies; documents stay, if need be with an empty text.  Null texts and rows without a key stay as they are."""
    return fuzzy_lines.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each SimHash component, that of the smallest key; null and empty texts are copies of each other, rows without a key stay."""
    return simhash.drop_near(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; every document stays, a null text stays null."""
    return secret_grammar.redact(docs, secret_grammar.fit(docs))


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens at most; every row is packed, a null or empty text as its end id alone."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", packing_),
]

#: Language models, MinHash components, automata and packing are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written once in the shared folder: later stages read what it kept instead of working it out again, and a lost executor costs one stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark) as tables:
        for _, stage in STAGES[:-1]:
            docs = tables.keep(stage(spark, docs, sf_dir))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
