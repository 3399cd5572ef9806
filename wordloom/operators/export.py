"""Export: hash shards, manifest, versions, CSV and reports."""

from __future__ import annotations

import hashlib
import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as T

SHARDS = {"en": 2048, "vi": 1024, "usage": 256}
MOST_FILES, MOST_BYTES = 10_000, 5_000_000


def shards(views: DataFrame, key: str, n: int) -> DataFrame:
    """SNK-12..16, MTH-05: shard and its JSON document, word -> view, keys sorted.

    A shard's size is its share of a lexicon; one document is one row, as the readers' files are.
    """
    fields = [c for c in sorted(views.columns) if c != key]
    rows = views.select(T.shard(key, n).alias("shard"), F.struct(F.col(key).alias("k"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("v")).alias("kv"))
    entry = lambda x: F.concat(F.to_json(F.array(x["k"])).substr(F.lit(2), F.length(F.to_json(F.array(x["k"]))) - 2), F.lit(":"), x["v"])
    return rows.groupBy("shard").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("kv")), entry), ","), F.lit("}")).alias("document"))


def write_shards(documents: DataFrame, path: str) -> None:
    documents.repartition("shard").sortWithinPartitions("shard").write.mode("overwrite").partitionBy("shard").text(path)


def read_shard(spark, path: str, word: str, n: int) -> DataFrame:
    """SRC-18, VAR-26, VAR-27: only the word's partition is read."""
    s = spark.range(1).select(T.shard(F.lit(word), n)).first()[0]
    return spark.read.schema("value string, shard int").text(path).where(F.col("shard") == s)


#: Characters of one document that is put together in one row.
MOST_TEXT = 256_000_000


def assert_small(df: DataFrame, *text: str, most: int = MOST_TEXT) -> None:
    """Raises if what is to become one document is too large for one: the cluster adds up the sizes first."""
    size = df.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in text), F.lit(3)))).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} characters are beyond the {most} of one document")


def version_id(files: DataFrame) -> DataFrame:
    """SNK-17: a hash of all names and contents: columns path, content (binary); of packages whose names are MOST_TEXT characters at most, else see ``versions``."""
    assert_small(files, "path")
    each = files.select(F.concat("path", F.lit("\0"), F.sha2("content", 256)).alias("line"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("version"))


def oversized(files: DataFrame) -> DataFrame:
    """VAR-21, FLT-33: files beyond the size limit or with an extension that isn't allowed."""
    return files.where((F.octet_length("content") > MOST_BYTES) | ~F.lower("path").rlike(r"\.(json|txt|html|js|css)$"))


def csv_text(lines: DataFrame, order: list, header: str) -> DataFrame:
    """SNK-18, SNK-20: one CSV text with BOM and CRLF, of MOST_TEXT characters at most; lines: column line."""
    assert_small(lines, "line")
    body = lines.select(F.struct(*order, "line").alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\r\n").alias("body"))
    return body.select(F.concat(F.lit("﻿" + header + "\r\n"), "body", F.lit("\r\n")).alias("text"))


def licences_markdown(source: DataFrame) -> DataFrame:
    """SNK-10: one table row for each source."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", T.escape_markdown("name"), T.escape_markdown("license"), T.escape_markdown("attribution")), F.lit(" |"))
    rows = source.select("id", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    return rows.select(F.concat(F.lit("| Source | Licence | Attribution |\n| --- | --- | --- |\n"), "rows").alias("text"))


def zipped(files: dict[str, bytes]) -> bytes:
    """SNK-09, SNK-11: a package of small text files (manifest, licences) with fixed times, so equal contents are equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name])
    return out.getvalue()


def sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def kept_versions(versions: DataFrame, keep: int = 2) -> DataFrame:
    """SNK-22: the newest versions stay."""
    return versions.orderBy(F.desc("created"), F.desc("version")).limit(keep)
