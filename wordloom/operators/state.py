"""User state as small tables: each operation takes the tables and returns the new ones (USR-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.relational import first_by, latest

KEPT = 500
DEFAULT_LIST = "My words"


def add_history(history: DataFrame, new: DataFrame, keep: int = KEPT) -> DataFrame:
    """USR-01: the last visit of each key, the newest ``keep`` of them; both tables: id, key, label, kind, ts."""
    return newest(latest(history.unionByName(new), ["key"], "ts", "id"), keep)


def latest_replies(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """VAR-34: of the replies (command, seq) those to the last request (command, seq) of their command; late ones to earlier requests are dropped, a repeated reply comes once."""
    last = asked.groupBy("command").agg(F.max("seq").alias("seq"))
    return first_by(replies, ["command", "seq"], [F.asc(c) for c in replies.columns if c not in ("command", "seq")]).join(last, ["command", "seq"], "left_semi")


def newest(history: DataFrame, n: int) -> DataFrame:
    """USR-02."""
    return history.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def cleared(table: DataFrame) -> DataFrame:
    """USR-03."""
    return table.limit(0)


def create_lists(lists: DataFrame, names: DataFrame, now: int) -> DataFrame:
    """USR-04, STR-34, STR-35: new lists by name; names that are there in whatever case, or aren't names, are passed over."""
    clean = names.withColumn("name", T.list_name("name")).where("name IS NOT NULL").withColumn("_key", F.lower("name"))
    fresh = first_by(clean, ["_key"], [F.asc("name")]).join(lists.select(F.lower("name").alias("_key")), "_key", "left_anti")
    top = lists.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    from pyspark.sql import Window as W

    # A user's lists are few; the new ones are numbered after the last.
    numbered = fresh.crossJoin(F.broadcast(top)).select((F.col("_top") + F.row_number().over(W.orderBy("name"))).alias("id"), "name", F.lit(now).cast("bigint").alias("created"))
    return lists.unionByName(numbered)


def rename_list(lists: DataFrame, list_id: int, name: str) -> DataFrame:
    """USR-05: unchanged where another list has that name."""
    clean = T.list_name(F.lit(name))
    taken = lists.where((F.lower("name") == F.lower(clean)) & (F.col("id") != list_id)).select(F.lit(True).alias("_taken")).limit(1)
    return lists.join(taken, F.lit(True), "left").withColumn("name", F.when((F.col("id") == list_id) & F.col("_taken").isNull() & clean.isNotNull(), clean).otherwise(F.col("name"))).drop("_taken")


def delete_list(lists: DataFrame, items: DataFrame, list_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    """USR-06: the list goes with its items; if none is left, a default one is there again."""
    left = lists.where(F.col("id") != list_id)
    none = left.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).cast("bigint").alias("id"), F.lit(DEFAULT_LIST).alias("name"), F.lit(now).cast("bigint").alias("created"))
    return left.unionByName(none), items.where(F.col("list_id") != list_id)


def list_items(items: DataFrame, list_id: int) -> DataFrame:
    """USR-07."""
    return items.where(F.col("list_id") == list_id).orderBy(F.desc("added_at"), F.desc("id"))


def list_counts(lists: DataFrame, items: DataFrame) -> DataFrame:
    """JOIN-08: lists with their number of items, 0 too."""
    n = items.groupBy(F.col("list_id").alias("id")).agg(F.count("*").alias("n"))
    return lists.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


ITEM_KEY = ["list_id", "word", "pos", "sense"]


def add_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """USR-08: items that aren't in their list yet."""
    return items.unionByName(first_by(new, ITEM_KEY, [F.asc("added_at"), F.asc("id")]).join(items, ITEM_KEY, "left_anti").select(*items.columns))


def remove_items(items: DataFrame, ids: list[int]) -> DataFrame:
    """USR-09."""
    return items.where(~F.col("id").isin(ids))


def toggled(items: DataFrame, keys: DataFrame) -> DataFrame:
    """VAR-43: each key is added if it isn't there and removed if it is."""
    return items.join(keys, ITEM_KEY, "left_anti").unionByName(keys.join(items, ITEM_KEY, "left_anti").select(*items.columns))


def saved_keys(items: DataFrame) -> DataFrame:
    """NST-15."""
    return items.select("list_id", F.concat_ws("|", "word", "pos", "sense").alias("key"))


def put_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    """USR-10: the new value wins."""
    both = settings.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(both, ["key"], [F.desc("_new"), F.asc("value")]).drop("_new")


def settings_map(settings: DataFrame) -> DataFrame:
    """NST-07."""
    return settings.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def active_list(lists: DataFrame, settings: DataFrame) -> DataFrame:
    """VAR-44: the chosen list if it is there, else the first."""
    chosen = settings.where("key = 'active_list'").select(F.col("value").try_cast("bigint").alias("_id"))
    return lists.join(chosen, F.lit(True), "left").orderBy(F.desc(F.coalesce(F.col("id") == F.col("_id"), F.lit(False))), F.asc("id")).limit(1).drop("_id")


#: Lists and items of a backup's document, about.
PART = 20_000


def backup(lists: DataFrame, items: DataFrame, history: DataFrame, settings: DataFrame, exported_at: str, app_version: str, most: int = PART) -> DataFrame:
    """SNK-21: one JSON document, or as many as hold ``most`` lists and items each; a longer list is in several.  History, KEPT visits, and settings are in the first."""
    sizes = items.groupBy("list_id").agg(F.count("*").alias("_n"))
    per = lists.join(sizes, lists["id"] == sizes["list_id"], "left").select("id", "name", F.ceil(F.coalesce("_n", F.lit(1)) / most).cast("bigint").alias("_pieces"))
    parts = max(1, -(-(lists.count() + items.count()) // most))
    piece = F.pmod(F.xxhash64("word", "pos", "sense", "added_at"), F.col("_pieces"))
    packed = items.join(per.select(F.col("id").alias("list_id"), "_pieces"), "list_id").groupBy("list_id", piece.alias("_piece")).agg(F.array_sort(F.collect_list(F.struct("added_at", "word", "pos", "sense", "label"))).alias("items"))
    part = F.pmod(F.xxhash64("id", F.coalesce("_piece", F.lit(0))), F.lit(parts)).alias("part")
    ls = per.join(packed, per["id"] == packed["list_id"], "left").groupBy(part).agg(F.array_sort(F.collect_list(F.struct("name", "items"))).alias("lists"))
    hs = history.agg(F.array_sort(F.collect_list(F.struct("ts", "key", "label", "kind"))).alias("history"))
    first = hs.join(settings_map(settings), F.lit(True)).withColumn("part", F.lit(0).cast("bigint"))
    body = lists.sparkSession.range(parts).withColumnRenamed("id", "part").join(ls, "part", "left").join(F.broadcast(first), "part", "left")
    none = {"lists": F.array(), "history": F.array(), "settings": F.create_map()}
    filled = [F.coalesce(n, x.cast(body.schema[n].dataType)).alias(n) for n, x in none.items()]
    head = {"format": F.lit("wordloom-backup"), "version": F.lit(1), "exported_at": F.lit(exported_at), "app_version": F.lit(app_version), "part": F.col("part"), "parts": F.lit(parts)}
    return body.select(F.to_json(F.struct(*[x.alias(n) for n, x in head.items()], *filled)).alias("document"))


BACKUP = "format string, version int, exported_at string, app_version string, part bigint, parts bigint, lists array<struct<name:string,items:array<struct<added_at:bigint,word:string,pos:string,sense:string,label:string>>>>, history array<struct<ts:bigint,key:string,label:string,kind:string>>, settings map<string,string>"


def read_backup(document: DataFrame) -> DataFrame:
    """USR-15: all or nothing: another format or version, or text that isn't such a document, raises when it is read."""
    body = document.select(F.from_json("document", BACKUP, {"mode": "FAILFAST"}).alias("b")).select("b.*")
    fine = (F.col("format") == "wordloom-backup") & (F.col("version") == 1) & F.col("lists").isNotNull()
    return body.withColumn("version", F.when(fine, F.col("version")).otherwise(F.raise_error(F.lit("not a backup")).cast("int")))


def assert_backup(body: DataFrame) -> None:
    """Raises what is wrong with documents, and where some of a backup's are missing; one row comes to the driver."""
    r = body.agg(F.sum("version"), F.coalesce(F.max("parts"), F.lit(1)).alias("parts"), F.count_distinct(F.coalesce("part", F.lit(0))).alias("found")).first()
    if r.found != r.parts:
        raise ValueError(f"{r.found} of {r.parts} documents of a backup")


def restore(lists: DataFrame, items: DataFrame, history: DataFrame, settings: DataFrame, body: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """USR-16, SET-09: lists merge by name, items by key, newer visits win, settings are replaced but for the active list."""
    theirs = body.select(F.explode("lists").alias("l")).select(F.col("l.name").alias("name"), F.col("l.items").alias("items"))
    merged = create_lists(lists, theirs.select("name"), now)
    flat = theirs.select(F.lower(T.list_name("name")).alias("_key"), F.explode("items").alias("x")).select("_key", "x.*")
    owned = flat.join(merged.select(F.lower("name").alias("_key"), F.col("id").alias("list_id")), "_key")
    new_items = add_items(items, owned.withColumn("id", F.xxhash64("list_id", "word", "pos", "sense")).select(*items.columns))
    visits = body.select(F.explode("history").alias("h")).select("h.*").withColumn("id", F.lit(0).cast("bigint")).select(*history.columns)
    values = body.select(F.explode("settings").alias("key", "value")).where("key <> 'active_list'")
    return merged, new_items, add_history(history, visits), put_settings(settings, values)
