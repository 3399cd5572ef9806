"""Schemas of the lexicon's tables, and writing them so that readers never see half a table."""

from __future__ import annotations

import re
import tempfile

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SNK-01..03, SNK-05, USR: column lists by table.
CORE = {
    "meta": "key string, value string",
    "source": "id string, name string, license string, attribution string, url string, retrieved_at string",
    "entry": "id bigint, entry_key string, headword string, headword_norm string, pos string, ord int, entry_type string, freq_rank bigint, freq_band string, cefr string, cefr_source string, tier string, etymology string, ai_model string",
    "headword": "word string, norm string, freq_rank bigint, tier string",
    "pronunciation": "entry_id bigint, accent string, ipa string, source string",
    "form": "entry_id bigint, ord int, form string, tags array<string>",
    "lookup_index": "form_norm string, headword string, relation string, tags array<string>",
    "sense": "id bigint, entry_id bigint, layer string, ord int, guideword string, grammar string, labels string, definition string, cefr string, vi string, vi_from_wikt boolean, src array<int>, is_ai boolean, source string",
    "example": "sense_id bigint, ord int, text_en string, text_vi string, is_ai boolean, source string",
    "thesaurus": "entry_id bigint, ord int, definition string, members array<string>, hypernyms array<string>",
    "antonym": "entry_id bigint, word string",
    "family": "headword string, member string",
    "phrase_link": "headword string, phrase string, kind string, gloss string, popularity bigint",
}
BILINGUAL = {
    "vi_block": "entry_id bigint, ord int, text string",
    "translation_group": "entry_id bigint, header string, words array<string>",
    "vi_headword": "word string, norm string, n_links bigint, has_wikt boolean",
    "vi_sense": "word string, ord int, pos string, gloss string",
    "vi_link": "vi string, headword string, pos string, guideword string, definition string, source string, weight int, freq_rank bigint",
    "tatoeba": "id bigint, en string, vi string",
    "tatoeba_word": "headword string, tid bigint",
}
USAGE = {
    "usage_prep": "headword string, pos string, prep string, obj string, n bigint, ratio double, common boolean",
    "usage_prep_seq": "headword string, pos string, seq string, n bigint",
    "usage_coll": "headword string, pos string, pattern string, display string, n bigint, rank int",
    "usage_example": "headword string, pos string, kind string, key string, text string, source string, hl_start int, hl_end int, n_words int, score double",
    "usage_role": "headword string, pos string, role string, n bigint",
}
CORPUS = {
    "prep_pattern": "lemma string, pos string, prep string, obj string, n bigint, ratio double, lift double, pass boolean, label string",
    "prep_seq": "lemma string, pos string, seq string, n bigint",
    "collocation": "lemma string, pos string, pattern string, display string, colloc string, n bigint, logdice double, rank int",
    "usage_example": "lemma string, pos string, kind string, key string, text string, source string, hl_start int, hl_end int, n_words int, score double",
    "role_count": "lemma string, pos string, role string, n bigint",
    "node_count": "lemma string, pos string, n bigint",
    "meta": "key string, value string",
}
USER = {
    "history": "id bigint, key string, label string, kind string, ts bigint",
    "wordlist": "id bigint, name string, created bigint",
    "wordlist_item": "id bigint, list_id bigint, word string, pos string, sense string, label string, added_at bigint",
    "settings": "key string, value string",
}
SCHEMA_VERSION = "2"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one only for a session on one machine that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wordloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """A table's columns in order and type; columns that are missing are null, others go (FLT-24: what can't be cast is null)."""
    want = df.sparkSession.createDataFrame([], schema).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def write_tables(tables: dict[str, DataFrame], root: str, schemas: dict[str, str]) -> None:
    """SNK-04..08: each table is written whole as a new version, and then one small file, replaced by a rename, points to it.

    So a failed write leaves the old version in place, and readers find one or the other.  The version before the last stays for
    readers that have it open; older ones go.
    """
    spark = next(iter(tables.values())).sparkSession
    path, fs = _files(spark, root)
    for name, df in tables.items():
        old, version = _version(spark, root, name), f"v-{uuid4().hex}"
        conform(df, schemas[name]).write.parquet(f"{root}/{name}/{version}")
        staged, place = path(f"{root}/{name}/_new"), path(f"{root}/{name}/_current")
        out = fs.create(staged, True)
        out.write(bytearray(version.encode()))
        out.close()
        options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, place, options)
        for s in fs.listStatus(path(f"{root}/{name}")):
            if s.getPath().getName().startswith("v-") and s.getPath().getName() not in (old, version):
                fs.delete(s.getPath(), True)


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _version(spark: SparkSession, root: str, name: str) -> str | None:
    path, fs = _files(spark, root)
    place = path(f"{root}/{name}/_current")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    found = bytes(stream.readAllBytes()).decode()
    stream.close()
    return found


def table_path(spark: SparkSession, root: str, name: str) -> str:
    """Where a table's current version is; a table without versions is read where it lies."""
    version = _version(spark, root, name)
    return f"{root}/{name}/{version}" if version else f"{root}/{name}"


def open_tables(spark: SparkSession, root: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """SRC-15, SRC-16: read-only tables; refuses another schema version."""
    if "meta" in schemas:
        found = spark.read.schema(schemas["meta"]).parquet(table_path(spark, root, "meta")).where("key = 'schema_version'").first()
        if found is None or found.value != SCHEMA_VERSION:
            raise ValueError(f"schema version {found and found.value}, not {SCHEMA_VERSION}")
    return {name: spark.read.schema(schema).parquet(table_path(spark, root, name)) for name, schema in schemas.items()}
