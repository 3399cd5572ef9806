"""Queries of report, date and selection operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import corpus as C
from wordloom.operators import export as E
from wordloom.operators import reports as P
from wordloom.operators import state as S
from wordloom.plans.corpus_queries import WITH, docs, kept, ranks, table


def totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19, AGG-20: kinds of events by their total."""
    return P.totals_by(P.counts_by(table(spark, d, "events"), "event_type", "user_id"), "event_type")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """FLT-27, JOIN-22: each word's four shortest of all sentences that have it or its form in s."""
    # Texts are split and sentences compared once, for the words and for their hits.
    clean = kept(spark, d, "sentences", lambda: C.clean_sentences(docs(spark, d)))
    words = ranks(spark, d, clean).select(F.col("word").alias("lemma"))
    forms = words.select("lemma", F.explode(F.array(F.col("lemma"), F.concat("lemma", F.lit("s")))).alias("form"))
    s = clean.select((F.col("doc_id") * 100000 + F.col("place")).alias("sid"), "sentence")
    return P.hits_of_forms(s, forms, first=None).select("lemma", "sid", "place")


HITS_SQL = WITH + """
, f AS (SELECT word AS lemma, unnest([word, word || 's']) AS form FROM ranks),
t AS (SELECT DISTINCT doc_id * 100000 + place AS sid, length(sentence) AS n, unnest(regexp_extract_all(lower(sentence), '[a-z][a-z'']*')) AS form FROM clean),
h AS (SELECT DISTINCT lemma, sid, n FROM t JOIN f USING (form))
SELECT lemma, sid, place FROM (SELECT lemma, sid, row_number() OVER (PARTITION BY lemma ORDER BY n, sid) AS place FROM h) WHERE place <= 4
"""


def dates(spark: SparkSession, d: str) -> DataFrame:
    """MTH-06..08, MTH-11, VAR-32: seconds, days and stamps of orders, and which customers' backups would be due."""
    o = table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    days = F.floor(F.unix_seconds("ts") / 86400).cast("int")
    return o.select("o_orderkey", F.unix_seconds("ts").alias("seconds"), T.stamp("ts").alias("stamp"), P.civil_date(days).cast("string").alias("day"), P.backup_due(F.col("o_custkey") % 20, F.unix_seconds("ts"), F.lit(893_000_000)).alias("due"), P.rank_key(F.nullif(F.col("o_orderkey") % 3, F.lit(0))).cast("string").alias("rank_key"), (T.now_seconds() > F.unix_seconds("ts")).alias("past"))


DATES_SQL = """
SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%Y%m%d-%H%M%S') AS stamp, strftime(DATE '1970-01-01' + (epoch(o_orderdate)::BIGINT // 86400)::INT, '%Y-%m-%d') AS day,
  o_custkey % 20 >= 10 AND 893000000 - epoch(o_orderdate)::BIGINT > 2592000 AS due, CASE WHEN o_orderkey % 3 = 0 THEN 'Infinity' ELSE (o_orderkey % 3)::VARCHAR || '.0' END AS rank_key, epoch(now()) > epoch(o_orderdate) AS past
FROM orders
"""


def roles(spark: SparkSession, d: str) -> DataFrame:
    """SRT-15: for each brand and type the commonest container size among parts that sold, and groups in fixed order."""
    p = table(spark, d, "part")
    counts = p.groupBy(F.col("p_brand").alias("headword"), F.lit("p").alias("pos"), F.col("p_size").cast("string").alias("role")).agg(F.count("*").alias("n"))
    shown = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("headword"), F.lit("p").alias("pos"), F.lit("role").alias("kind"), F.col("p_size").cast("string").alias("key"))
    return P.default_role(counts, shown).select("headword", "role")


ROLES_SQL = """
SELECT headword, role FROM (
  SELECT p_brand AS headword, p_size::VARCHAR AS role, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size::VARCHAR DESC) AS k FROM part
  WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part WHERE p_partkey % 2 = 0) GROUP BY p_brand, p_size) WHERE k = 1
"""


def preposition_rows(spark: SparkSession, d: str) -> DataFrame:
    """VAR-39, WIN-06: two examples of each priority of a customer's orders."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("headword"), F.lit("v").alias("pos"), F.lit("prep").alias("kind"), F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("key"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").cast("string").alias("text"))
    return P.preposition_examples(o).select("headword", "prep", "text", "place")


def unique_examples(spark: SparkSession, d: str) -> DataFrame:
    """FLT-32: a customer's orders as examples, one of each priority's texts."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("headword"), F.lit("v").alias("pos"), F.col("o_orderpriority").alias("text"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("key"))
    return P.unique_examples(o).select("headword", "text", "score", "key")


UNIQUE_SQL = """
SELECT headword, text, score, key FROM (
  SELECT o_custkey AS headword, o_orderpriority AS text, o_totalprice AS score, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1
"""


def late_replies(spark: SparkSession, d: str) -> DataFrame:
    """VAR-34: users' events as requests, two in three of them answered; only a reply to a command's last request counts."""
    e = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id") % 500, "event_type").alias("command"), F.col("event_id").alias("seq"), "value")
    return S.latest_replies(e.where("seq % 3 <> 0"), e.select("command", "seq"))


REPLIES_SQL = """
WITH e AS (SELECT (user_id % 500)::VARCHAR || ':' || event_type AS command, event_id AS seq, value FROM events)
SELECT command, seq, value FROM e WHERE seq % 3 <> 0 AND (command, seq) IN (SELECT (command, max(seq)) FROM e GROUP BY command)
"""


PREPOSITION_SQL = """
SELECT o_custkey AS headword, o_orderpriority AS prep, o_orderkey::VARCHAR AS text, place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS place FROM orders) WHERE place <= 2
"""


def licence_text(spark: SparkSession, d: str) -> DataFrame:
    """SNK-10, STR-40: nations as sources, one Markdown table."""
    n = table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("id"), F.col("n_name").alias("name"), F.lit("CC*0").alias("license"), F.lit("a|b").alias("attribution"))
    return E.licences_markdown(n)


LICENCE_SQL = r"""
SELECT '| Source | Licence | Attribution |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || replace(n_name, '_', '\_') || ' | CC\*0 | a\|b |', chr(10) ORDER BY n_nationkey) AS text FROM nation
"""


def shard_documents(spark: SparkSession, d: str) -> DataFrame:
    """SNK-12..14, MTH-05: customers' views in 64 documents; the size of each and how many entries it holds."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("word"), "c_nationkey", "c_mktsegment")
    return E.shards(c, "word", 64).select("shard", F.length("document").alias("letters"), F.size(F.json_object_keys("document")).alias("entries"))


SHARDS_SQL = """
WITH h AS (SELECT *, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) % 64)::INT AS shard FROM customer)
SELECT shard, sum(length('"' || c_name || '":{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') + 1)::BIGINT + 1 AS letters, count(*)::INT AS entries FROM h GROUP BY shard
"""


def settings(spark: SparkSession, d: str) -> DataFrame:
    """USR-10, NST-07: each user's first and last value of a kind, the last one wins; as a map's entries."""
    e = table(spark, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_id").cast("string").alias("value"))
    first = e.groupBy("key").agg(F.min("value").alias("value"))
    out = S.put_settings(first, e.groupBy("key").agg(F.max("value").alias("value")).where("key LIKE '1%'"))
    return S.settings_map(out).select(F.explode("settings").alias("key", "value"))


SETTINGS_SQL = """
SELECT user_id::VARCHAR || ':' || event_type AS key, CASE WHEN user_id::VARCHAR LIKE '1%' THEN max(event_id::VARCHAR) ELSE min(event_id::VARCHAR) END AS value FROM events GROUP BY user_id, event_type
"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """STR-37, STR-33, STR-31, STR-34, VAR-45: comparisons and names made of orders."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws(".", F.col("o_orderkey") % 5, F.col("o_custkey") % 13, F.lit(2)).alias("a"), F.concat_ws(".", F.col("o_custkey") % 5, F.col("o_orderkey") % 13).alias("b"), F.concat_ws("  /", "o_orderpriority", "o_orderstatus").alias("name"))
    return o.select("o_orderkey", T.version_less("a", "b").alias("less"), T.safe_file_name("name").alias("file"), T.list_name("name").alias("list"), T.url_encode("name").alias("address"))


VERSIONS_SQL = r"""
SELECT o_orderkey, (o_orderkey % 5, o_custkey % 13, 2) < (o_custkey % 5, o_orderkey % 13, 0) AS less, regexp_replace(name, '[^\p{L}\p{N} _\-]', '_', 'g') AS file,
  trim(regexp_replace(name, '\s+', ' ', 'g')) AS list, url_encode(name) AS address FROM (SELECT *, o_orderpriority || '  /' || o_orderstatus AS name FROM orders)
"""

QUERIES = {
    "totals_by_kind": (totals, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "surface_hits": (hits, HITS_SQL),
    "dates_and_stamps": (dates, DATES_SQL),
    "default_role": (roles, ROLES_SQL),
    "unique_examples": (unique_examples, UNIQUE_SQL),
    "late_replies": (late_replies, REPLIES_SQL),
    "preposition_examples": (preposition_rows, PREPOSITION_SQL),
    "licence_table": (licence_text, LICENCE_SQL),
    "shard_documents": (shard_documents, SHARDS_SQL),
    "settings_upsert": (settings, SETTINGS_SQL),
    "versions_and_names": (versions, VERSIONS_SQL),
}
