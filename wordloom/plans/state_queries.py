"""Queries of the user's state: lists, items, settings, history, backups; the events stand for what users did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import state as S
from wordloom.operators.service import Service
from wordloom.operators.tables import USER
from wordloom.plans.corpus_queries import table


def lists(spark: SparkSession, d: str) -> DataFrame:
    """Users as lists: id and name."""
    e = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return e.select("id", F.concat(F.lit("List "), "id").alias("name"), F.lit(7).cast("bigint").alias("created"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Each user's kinds of events and last digits as items, each once."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("list_id"), F.col("event_type").alias("word"), F.lit("v").alias("pos"), (F.col("event_id") % 7).cast("string").alias("sense"), F.lit("x").alias("label"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("added_at"))
    return S.add_items(e.limit(0), e)


ITEMS = """
items AS (SELECT * FROM (
  SELECT event_id AS id, user_id AS list_id, event_type AS word, 'v' AS pos, (event_id % 7)::VARCHAR AS sense, 'x' AS label, epoch(date_trunc('second', ts))::BIGINT AS added_at,
    row_number() OVER (PARTITION BY user_id, event_type, event_id % 7 ORDER BY date_trunc('second', ts), event_id) AS k FROM events) WHERE k = 1)
"""


def item_rows(spark: SparkSession, d: str) -> DataFrame:
    """USR-08: of equal items the one added first."""
    return items(spark, d).select("id", "list_id", "word", "sense", "added_at")


def create_lists(spark: SparkSession, d: str) -> DataFrame:
    """USR-04, STR-34, STR-35: customers' segments and nations as new names, in several cases and with spaces, beside lists that are there."""
    old = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lower("n_name").alias("name"), F.lit(1).cast("bigint").alias("created"))
    c = table(spark, d, "customer")
    names = c.select(F.concat(F.lit(" "), F.initcap(F.lower("c_mktsegment"))).alias("name")).union(c.select(F.concat(F.lit("Nation_"), "c_nationkey"))).union(c.select(F.lit("  "))).union(c.select(F.repeat(F.lit("x"), 81)))
    return S.create_lists(old, names, 5)


CREATE_SQL = """
WITH o AS (SELECT n_nationkey::BIGINT AS id, lower(n_name) AS name, 1::BIGINT AS created FROM nation WHERE n_nationkey < 10),
n AS (SELECT DISTINCT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS name FROM customer UNION SELECT DISTINCT 'Nation_' || c_nationkey FROM customer),
f AS (SELECT min(name) AS name FROM n WHERE lower(name) NOT IN (SELECT lower(name) FROM o) GROUP BY lower(name))
SELECT * FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY name), name, 5 FROM f
"""


def rename_lists(spark: SparkSession, d: str) -> DataFrame:
    """USR-05: one list takes a new name, another one can't take a name that is there."""
    return S.rename_list(S.rename_list(lists(spark, d), 3, "  Mine   and yours "), 4, "list 5")


RENAME_SQL = "SELECT DISTINCT user_id AS id, CASE WHEN user_id = 3 THEN 'Mine and yours' ELSE 'List ' || user_id END AS name, 7::BIGINT AS created FROM events"


def delete_list(spark: SparkSession, d: str) -> DataFrame:
    """USR-06, JOIN-08: a list goes with its items; those left with their number of items."""
    left, kept = S.delete_list(lists(spark, d), items(spark, d), 3, 9)
    return S.list_counts(left, kept).select("id", "name", "n")


DELETE_SQL = f"WITH {ITEMS} SELECT list_id AS id, 'List ' || list_id AS name, count(*) AS n FROM items WHERE list_id <> 3 GROUP BY list_id"


def last_list(spark: SparkSession, d: str) -> DataFrame:
    """USR-06, USR-03: the only list goes, a default one is there again; the history is cleared."""
    left, kept = S.delete_list(lists(spark, d).where("id = 3"), items(spark, d).where("list_id = 3"), 3, 9)
    return S.list_counts(left, kept).unionByName(S.cleared(lists(spark, d)).withColumn("n", F.lit(0).cast("bigint")))


def item_list(spark: SparkSession, d: str) -> DataFrame:
    """USR-07, USR-09: one list's items, newest first by place, without those of two kinds of ids."""
    from pyspark.sql import Window as W

    gone = [7, 70, 700]
    return S.list_items(S.remove_items(items(spark, d), gone), 2).select("id", "word", "sense", F.row_number().over(W.orderBy(F.desc("added_at"), F.desc("id"))).alias("place"))


ITEM_LIST_SQL = f"WITH {ITEMS} SELECT id, word, sense, row_number() OVER (ORDER BY added_at DESC, id DESC)::INT AS place FROM items WHERE list_id = 2 AND id NOT IN (7, 70, 700)"


def toggled_items(spark: SparkSession, d: str) -> DataFrame:
    """VAR-43, NST-15: items of even users toggled with all of sense 0 to 2: what both have goes, the rest stays; as keys."""
    i = items(spark, d)
    return S.saved_keys(S.toggled(i.where("list_id % 2 = 0"), i.where("sense < '3'")))


TOGGLE_SQL = f"""
WITH {ITEMS} SELECT list_id, concat_ws('|', word, pos, sense) AS key FROM items WHERE (list_id % 2 = 0) <> (sense < '3')
"""


def active_list(spark: SparkSession, d: str) -> DataFrame:
    """VAR-44: the chosen list, and the first where the choice isn't there."""
    some = lists(spark, d)
    setting = lambda v: spark.createDataFrame([("active_list", v), ("other", "1")], "key string, value string")
    return S.active_list(some, setting("4")).unionByName(S.active_list(some, setting("nonsense")))


ACTIVE_SQL = "SELECT 4::BIGINT AS id, 'List 4' AS name, 7::BIGINT AS created UNION ALL SELECT min(user_id), 'List ' || min(user_id), 7 FROM events"


def _backup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    history = e.select(F.col("event_id").alias("id"), F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_type").alias("label"), F.lit("event").alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    settings = e.groupBy(F.col("event_type").alias("key")).agg(F.max("event_id").cast("string").alias("value")).union(spark.createDataFrame([("active_list", "3")], "key string, value string"))
    return S.backup(lists(spark, d), items(spark, d), S.add_history(history.limit(0), history), settings, "2026-01-01", "1.2.3")


def backup(spark: SparkSession, d: str) -> DataFrame:
    """SNK-21, USR-15, NST-07: a backup as one JSON document, read again: each list's items, visits and settings."""
    b = S.read_backup(_backup(spark, d))
    # A list may be in several documents.
    pieces = b.select(F.explode("lists").alias("l")).select(F.col("l.name").alias("name"), F.size("l.items").cast("bigint").alias("n"), F.slice(F.transform("l.items", lambda x: F.struct(x["added_at"], x["word"], x["sense"])), 1, 3).alias("x"))
    three = F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, 3)
    per_list = pieces.groupBy("name").agg(F.sum("n").alias("n"), three.alias("x")).select(F.lit("list").alias("part"), "name", "n", F.array_join(F.transform("x", lambda x: F.concat_ws("|", x["added_at"], x["word"], x["sense"])), ",").alias("first_ones"))
    last = F.try_element_at("history", F.lit(-1))
    visits = b.groupBy(F.col("format").alias("name")).agg(F.sum(F.size("history")).alias("n"), F.max(last).alias("x")).select(F.lit("history").alias("part"), "name", "n", F.col("x.key").alias("first_ones"))
    values = b.select(F.explode("settings").alias("name", "first_ones")).select(F.lit("setting").alias("part"), "name", F.lit(1).cast("bigint").alias("n"), "first_ones")
    return per_list.unionByName(visits).unionByName(values)


BACKUP_SQL = f"""
WITH {ITEMS},
l AS (SELECT list_id, count(*) AS n, list(added_at || '|' || word || '|' || sense ORDER BY added_at, word, sense)[:3] AS first_ones FROM items GROUP BY list_id),
h AS (SELECT event_id AS id, user_id || ':' || event_type AS key, epoch(date_trunc('second', ts))::BIGINT AS t FROM events),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, id DESC) AS k FROM h) WHERE k = 1 ORDER BY t DESC, id DESC LIMIT 500)
SELECT 'list' AS part, 'List ' || list_id AS name, n, array_to_string(first_ones, ',') AS first_ones FROM l
UNION ALL SELECT 'history', 'wordloom-backup', count(*), arg_max(key, (t, key)) FROM u
UNION ALL SELECT 'setting', event_type, 1, max(event_id)::VARCHAR FROM events GROUP BY event_type
UNION ALL SELECT 'setting', 'active_list', 1, '3'
"""


def restore(spark: SparkSession, d: str) -> DataFrame:
    """USR-16, SET-09: the backup merges into a state that has half of the lists, items and an older setting; counts and values after it."""
    body = S.read_backup(_backup(spark, d))
    half, some = lists(spark, d).where("id % 2 = 0"), items(spark, d).where("list_id % 4 = 0")
    none = spark.createDataFrame([], "id bigint, key string, label string, kind string, ts bigint")
    old = spark.createDataFrame([("click", "old"), ("active_list", "1")], "key string, value string")
    ls, its, visits, values = S.restore(half, some, none, old, body, 11)
    per = S.list_counts(ls, its).select(F.lit("list").alias("part"), "name", F.col("n").cast("string").alias("value"))
    seen = visits.select(F.lit("visit").alias("part"), F.col("key").alias("name"), F.col("ts").cast("string").alias("value"))
    return per.unionByName(seen).unionByName(values.select(F.lit("setting").alias("part"), F.col("key").alias("name"), "value"))


RESTORE_SQL = f"""
WITH {ITEMS},
h AS (SELECT event_id AS id, user_id || ':' || event_type AS key, epoch(date_trunc('second', ts))::BIGINT AS t FROM events),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, id DESC) AS k FROM h) WHERE k = 1 ORDER BY t DESC, id DESC LIMIT 500)
SELECT 'list' AS part, 'List ' || list_id AS name, count(*)::VARCHAR AS value FROM items GROUP BY list_id
UNION ALL SELECT 'visit', key, t::VARCHAR FROM u
UNION ALL SELECT 'setting', event_type, max(event_id)::VARCHAR FROM events GROUP BY event_type
UNION ALL SELECT 'setting', 'active_list', '1'
"""

def _service(spark: SparkSession, d: str) -> Service:
    """The facade over nations as headwords and sources, and over users' lists."""
    n = table(spark, d, "nation")
    words = n.select(F.col("n_name").alias("word"), F.lower("n_name").alias("norm"), F.col("n_nationkey").cast("bigint").alias("freq_rank"))
    sources = n.select(F.lower("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("CC0").alias("license"))
    none = spark.createDataFrame([], USER["settings"])
    return Service({"headword": words, "source": sources}, {"wordlist": lists(spark, d), "wordlist_item": items(spark, d), "settings": none, "history": spark.createDataFrame([], USER["history"])})


def service_sources(spark: SparkSession, d: str) -> DataFrame:
    """LKP-10: all sources, by command."""
    return _service(spark, d).call("sources")


def list_commands(spark: SparkSession, d: str) -> DataFrame:
    """LKP-15: lists are renamed and deleted, items removed and toggled, all by command; each list with its number of items."""
    s = _service(spark, d)
    s.call("list_rename", list_id=3, name=" Mine ")
    s.call("list_delete", list_id=4, now=9)
    s.call("item_remove", ids=[1, 2, 3])
    s.call("item_toggle", keys=items(spark, d).where("sense = '5'"))
    return s.call("lists").select("id", "name", "n")


LIST_COMMANDS_SQL = f"""
WITH {ITEMS}, u AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id <> 4),
n AS (SELECT list_id AS id, count(*) AS n FROM items WHERE id NOT IN (1, 2, 3) AND sense <> '5' GROUP BY list_id),
again AS (SELECT list_id AS id, count(*) AS k FROM items WHERE (id IN (1, 2, 3) OR list_id = 4) AND sense = '5' GROUP BY list_id)
SELECT id, CASE WHEN id = 3 THEN 'Mine' ELSE 'List ' || id END AS name, coalesce(n, 0) + coalesce(k, 0) AS n FROM u LEFT JOIN n USING (id) LEFT JOIN again USING (id)
"""


def csv_commands(spark: SparkSession, d: str) -> DataFrame:
    """LKP-15, SNK-18..20: lists as CSV texts, by command."""
    s = _service(spark, d)
    return s.call("csv", list_id=5).withColumn("list_id", F.lit(5)).unionByName(s.call("csv", list_id=6).withColumn("list_id", F.lit(6)))


CSV_COMMANDS_SQL = f"""
WITH {ITEMS} SELECT list_id::INT AS list_id, chr(65279) || 'word,pos,sense,label' || chr(13) || chr(10) || string_agg(word || ',v,' || sense || ',x', chr(13) || chr(10) ORDER BY added_at DESC, id DESC) || chr(13) || chr(10) AS text
FROM items WHERE list_id IN (5, 6) GROUP BY list_id
"""


def restore_commands(spark: SparkSession, d: str) -> DataFrame:
    """LKP-15, USR-15, USR-16: a backup of some lists by command, everything cleared, and the backup restored by command."""
    s = _service(spark, d)
    s.user["wordlist"], s.user["wordlist_item"] = s.user["wordlist"].where("id < 40"), s.user["wordlist_item"].where("list_id < 40")
    saved = s.call("backup", exported_at="now", app_version="1")
    s.call("clear")
    return s.call("restore", document=saved, now=8).select("name", "created", "n")


RESTORE_COMMANDS_SQL = f"WITH {ITEMS} SELECT 'List ' || list_id AS name, 8::BIGINT AS created, count(*) AS n FROM items WHERE list_id < 40 GROUP BY list_id"


QUERIES = {
    "service_sources": (service_sources, "SELECT lower(n_name) AS id, n_name AS name, 'CC0' AS license FROM nation"),
    "list_commands": (list_commands, LIST_COMMANDS_SQL),
    "csv_commands": (csv_commands, CSV_COMMANDS_SQL),
    "restore_commands": (restore_commands, RESTORE_COMMANDS_SQL),
    "item_rows": (item_rows, f"WITH {ITEMS} SELECT id, list_id, word, sense, added_at FROM items"),
    "create_lists": (create_lists, CREATE_SQL),
    "rename_lists": (rename_lists, RENAME_SQL),
    "delete_list": (delete_list, DELETE_SQL),
    "last_list": (last_list, "SELECT 1::BIGINT AS id, 'My words' AS name, 9::BIGINT AS created, 0::BIGINT AS n"),
    "list_items": (item_list, ITEM_LIST_SQL),
    "toggled_items": (toggled_items, TOGGLE_SQL),
    "active_list": (active_list, ACTIVE_SQL),
    "backup": (backup, BACKUP_SQL),
    "restore": (restore, RESTORE_SQL),
}
