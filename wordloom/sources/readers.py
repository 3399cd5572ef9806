"""Readers with declared schemas (SRC-*).  All go through Spark's file sources, so any store that it knows works."""

from __future__ import annotations

import io
import tomllib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.corpus import article_sentences

_WORD = "array<struct<word:string>>"
_TRANSLATIONS = "array<struct<code:string,word:string,sense:string>>"
DICTIONARY = (
    "word string, lang_code string, pos string, etymology_number int, etymology_text string, "
    f"senses array<struct<glosses:array<string>,tags:array<string>,form_of:{_WORD},alt_of:{_WORD},examples:array<struct<text:string,type:string>>,translations:{_TRANSLATIONS},synonyms:{_WORD},antonyms:{_WORD}>>, "
    f"forms array<struct<form:string,tags:array<string>,source:string>>, sounds array<struct<ipa:string,tags:array<string>,audio:string>>, translations {_TRANSLATIONS}, derived {_WORD}, synonyms {_WORD}, antonyms {_WORD}"
)
RESULT = "word string, pos string, senses array<struct<src:array<int>,guideword:string,grammar:string,labels:string,definition:string,vi:string,cefr:string,examples:array<struct<en:string,vi:string>>,vi_ok:boolean>>"


def frequency_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: only four columns are read."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).select("word", "phonetic", "bnc", "frq")


def profile_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """SRC-02: the byte-order mark of the first name goes."""
    df = spark.read.csv(list(paths), header=True)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def dictionary(spark: SparkSession, path: str, lang: str | None = "en") -> DataFrame:
    """SRC-03..05, O1: JSON lines, gzip or plain; a line without the language's mark isn't parsed.  Adds place, the order of lines.

    place rises with the file and the line; it isn't gapless.
    """
    lines = spark.read.text(path)
    if lang:
        lines = lines.where(F.col("value").contains(f'"lang_code": "{lang}"'))
    return lines.select(F.from_json("value", DICTIONARY).alias("d"), F.monotonically_increasing_id().alias("place")).where("d.word IS NOT NULL").select("d.*", "place")


def sentence_tsv(spark: SparkSession, path: str, lang: str = "eng") -> DataFrame:
    """SRC-06: id, lang, text; lines of other widths and languages are out."""
    rows = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).where(F.size("p") == 3)
    return rows.select(F.col("p")[0].alias("id"), F.col("p")[1].alias("lang"), F.col("p")[2].alias("text")).where(F.col("lang") == lang)


def link_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: vie_id, eng_id and place."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("p"), F.monotonically_increasing_id().alias("place")).where(F.size("p") >= 2)
    return rows.select(F.col("p")[0].alias("vie_id"), F.col("p")[1].alias("eng_id"), "place")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: sentences of articles in the main name space; lines that aren't such documents are out."""
    docs = spark.read.schema("text string, namespace int").json(path, mode="DROPMALFORMED").where("text IS NOT NULL AND coalesce(namespace, 0) = 0")
    return article_sentences(docs)


def corpora(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """SRC-08, SET-10, T14: source, priority and sentence of all corpora; a missing file fails when its path is resolved."""
    out = None
    for k, (name, path) in enumerate(paths.items()):
        one = sentence_tsv(spark, path).select(F.col("text").alias("sentence")) if name.startswith("tatoeba") else articles(spark, path).select("sentence")
        one = one.select(F.lit(name).alias("source"), F.lit(k).alias("priority"), F.monotonically_increasing_id().alias("place"), "sentence")
        out = one if out is None else out.unionByName(one)
    return out


def zip_members(spark: SparkSession, path: str, pattern: str = r".*\.json") -> DataFrame:
    """SRC-09, VAR-16: name and content of an archive's members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for n in z.namelist():
                        yield pd.DataFrame({"name": [n], "content": [z.read(n).decode()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, content string").where(F.col("name").rlike(pattern))


def word_net(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-09: links (word, pos, ord, synset) and synsets (id, members, definition, hypernym)."""
    files = zip_members(spark, path)
    entry = "map<string,map<string,struct<sense:array<struct<synset:string,antonym:array<string>>>>>>"
    synset = "map<string,struct<members:array<string>,definition:array<string>,hypernym:array<string>>>"
    e = files.where(F.col("name").contains("entries-")).select(F.explode(F.from_json("content", entry)).alias("word", "by_pos")).select("word", F.explode("by_pos").alias("pos", "x"))
    s = files.where(~F.col("name").contains("entries-")).select(F.explode(F.from_json("content", synset)).alias("id", "s"))
    return e.select("word", "pos", F.posexplode("x.sense").alias("ord", "s")).select("word", "pos", "ord", F.col("s.synset").alias("synset")), s.select("id", "s.*")


def catalogue(spark: SparkSession, text: str) -> DataFrame:
    """SRC-11: sources of a TOML text; one without a licence is refused."""
    rows = [(s["id"], s.get("name"), s.get("url"), s.get("file"), s.get("license"), s.get("attribution")) for s in tomllib.loads(text)["source"]]
    bare = [r[0] for r in rows if not r[4]]
    if bare:
        raise ValueError(f"sources without a licence: {bare}")
    return spark.createDataFrame(rows, "id string, name string, url string, file string, license string, attribution string")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def stale_sources(sources: DataFrame, lock: DataFrame) -> DataFrame:
    """SRC-14: sources whose content isn't that of the lock."""
    return sources.join(lock, ["id", "sha256"], "left_anti")


def results(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21, SRC-22, NST-06: word, pos, senses, model and file of model results."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    body = files.select("file", F.from_json(T.json_inside("value"), f"meta struct<model:string>, result struct<entries:array<struct<{RESULT.replace(' string', ':string').replace(' array', ':array')}>>>").alias("b"))
    return body.select("file", F.col("b.meta.model").alias("model"), F.explode("b.result.entries").alias("e")).select("e.*", "model", "file")
