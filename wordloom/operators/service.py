"""One facade over the lookup tables and the user's state: a command and its arguments give a DataFrame."""

from __future__ import annotations

import argparse
import os
import re
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import export, lookup, nested, quality, state
from wordloom.operators.tables import SCHEMA_VERSION, USER, _files, conform, table_path, write_tables


def locate(*candidates: str | None, variable: str = "WORDLOOM_TABLES") -> str:
    """VAR-50: the environment's path, else the first given one."""
    found = next((p for p in (os.environ.get(variable), *candidates) if p), None)
    if not found:
        raise FileNotFoundError(f"no tables given and {variable} is not set")
    return found


class Service:
    """LKP-10..12, LKP-14, LKP-15: dictionary commands take many queries at once; state commands return the new table."""

    def __init__(self, tables: dict[str, DataFrame], user: dict[str, DataFrame] | None = None) -> None:
        self.t, self.user = tables, dict(user or {})
        self.words = tables["headword"]

    def call(self, command: str, **a) -> DataFrame:
        method = getattr(self, f"do_{command}", None)
        if method is None:
            raise KeyError(f"no command {command}")
        return method(**a)

    def do_suggest(self, queries: DataFrame) -> DataFrame:
        return lookup.suggest(queries, self.words, self.t["vi_headword"], self.t["lookup_index"])

    def do_lookup(self, queries: DataFrame) -> DataFrame:
        return lookup.lookup(queries, self.words, self.t["lookup_index"], self.t["vi_headword"])

    def do_fuzzy(self, queries: DataFrame) -> DataFrame:
        return lookup.fuzzy(queries, self.words, lookup.gram_index(self.words))

    def do_get_entry(self, words: DataFrame) -> DataFrame:
        views = nested.entry_views(self.t["entry"], self.t["sense"], self.t["example"], self.t["form"], self.t["pronunciation"])
        return views.join(words, "word", "left_semi")

    def do_get_usage(self, words: DataFrame) -> DataFrame:
        return nested.usage_views(*(self.t[x] for x in ("usage_prep", "usage_coll", "usage_example", "usage_prep_seq"))).join(words, "word", "left_semi")

    def do_exists(self, queries: DataFrame) -> DataFrame:
        return lookup.exists(queries, self.words)

    def do_sources(self) -> DataFrame:
        return self.t["source"]

    def do_counts(self) -> DataFrame:
        return quality.table_counts(self.t)

    def do_history(self, n: int = 100) -> DataFrame:
        return state.newest(self.user["history"], n)

    def do_history_add(self, new: DataFrame) -> DataFrame:
        self.user["history"] = state.add_history(self.user["history"], new)
        return self.user["history"]

    def do_history_clear(self) -> DataFrame:
        self.user["history"] = state.cleared(self.user["history"])
        return self.user["history"]

    def do_lists(self) -> DataFrame:
        return state.list_counts(self.user["wordlist"], self.user["wordlist_item"])

    def do_list_create(self, names: DataFrame, now: int) -> DataFrame:
        self.user["wordlist"] = state.create_lists(self.user["wordlist"], names, now)
        return self.user["wordlist"]

    def do_list_rename(self, list_id: int, name: str) -> DataFrame:
        self.user["wordlist"] = state.rename_list(self.user["wordlist"], list_id, name)
        return self.user["wordlist"]

    def do_list_delete(self, list_id: int, now: int) -> DataFrame:
        self.user["wordlist"], self.user["wordlist_item"] = state.delete_list(self.user["wordlist"], self.user["wordlist_item"], list_id, now)
        return self.user["wordlist"]

    def do_active_list(self) -> DataFrame:
        return state.active_list(self.user["wordlist"], self.user["settings"])

    def do_items(self, list_id: int) -> DataFrame:
        """JOIN-20: a list's items with a flag whether the word is still there."""
        known = self.words.select("word", F.lit(True).alias("_known")).distinct()
        return state.list_items(self.user["wordlist_item"], list_id).join(known, "word", "left").withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")

    def do_item_add(self, new: DataFrame) -> DataFrame:
        self.user["wordlist_item"] = state.add_items(self.user["wordlist_item"], new)
        return self.user["wordlist_item"]

    def do_item_remove(self, ids: list[int]) -> DataFrame:
        self.user["wordlist_item"] = state.remove_items(self.user["wordlist_item"], ids)
        return self.user["wordlist_item"]

    def do_item_toggle(self, keys: DataFrame) -> DataFrame:
        self.user["wordlist_item"] = state.toggled(self.user["wordlist_item"], keys)
        return self.user["wordlist_item"]

    def do_saved_keys(self, list_id: int) -> DataFrame:
        return state.saved_keys(self.user["wordlist_item"].where(F.col("list_id") == list_id))

    def do_csv(self, list_id: int) -> DataFrame:
        """SNK-18..20: a list's items as one CSV text, the newest first."""
        items = state.list_items(self.user["wordlist_item"], list_id).select("added_at", "id", nested.csv_line("word", "pos", "sense", "label").alias("line"))
        return export.csv_text(items.withColumns({"_a": -F.col("added_at"), "_i": -F.col("id")}), ["_a", "_i"], "word,pos,sense,label")

    def do_settings(self) -> DataFrame:
        return state.settings_map(self.user["settings"])

    def do_setting_set(self, new: DataFrame) -> DataFrame:
        self.user["settings"] = state.put_settings(self.user["settings"], new)
        return self.user["settings"]

    def do_backup(self, exported_at: str, app_version: str) -> DataFrame:
        return state.backup(self.user["wordlist"], self.user["wordlist_item"], self.user["history"], self.user["settings"], exported_at, app_version)

    def do_restore(self, document: DataFrame, now: int) -> DataFrame:
        """USR-15, USR-16: a backup's lists, items, visits and settings, merged with what is there; a document that isn't one raises and changes nothing."""
        body = state.read_backup(document)
        state.assert_backup(body)
        names = ("wordlist", "wordlist_item", "history", "settings")
        self.user.update(zip(names, state.restore(*(self.user[n] for n in names), body, now)))
        return self.do_lists()

    def do_clear(self) -> DataFrame:
        """USR-03: all of the user's tables, empty."""
        self.user = {name: state.cleared(df) for name, df in self.user.items()}
        return self.do_lists()


def open_user_state(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """USR-11..14: the user's tables; one that is missing begins empty, one whose files are no such table is moved aside and begins empty.

    Older tables without a column get it as null: ``conform`` is the migration.  Any other error, such as a store that can't be
    reached, is raised: the table stays where it is.
    """
    path, fs = _files(spark, root)
    out = {}
    for name, schema in USER.items():
        df = None
        if fs.exists(path(f"{root}/{name}")):
            try:
                df = conform(spark.read.parquet(table_path(spark, root, name)), schema)
                df.count()
            except (PySparkException, Py4JJavaError) as e:
                if not re.search("CANNOT_READ_FILE_FOOTER|UNABLE_TO_INFER_SCHEMA|FAILED_READ_FILE|is not a Parquet file|PARQUET", str(e)):
                    raise
                fs.rename(path(f"{root}/{name}"), path(f"{root}/_damaged_{name}_{uuid4().hex}"))
                df = None
        out[name] = spark.createDataFrame([], schema) if df is None else df
    return out


def save_user_state(user: dict[str, DataFrame], root: str) -> None:
    write_tables(user, root, USER)


def is_stale(manifest_version: str, found: str | None) -> bool:
    """VAR-33: whether a reader's version isn't the published one."""
    return found != manifest_version


def main(argv: list[str] | None = None) -> None:
    """LKP-13: spark-submit entry: suggest, lookup or fuzzy over words given on the command line."""
    from wordloom.operators.tables import BILINGUAL, CORE, open_tables

    p = argparse.ArgumentParser(prog="wordloom")
    p.add_argument("command", choices=["suggest", "lookup", "fuzzy", "counts"])
    p.add_argument("queries", nargs="*")
    p.add_argument("--tables")
    p.add_argument("--mode", default="envi")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"wordloom-{SCHEMA_VERSION}").getOrCreate()
    s = Service(open_tables(spark, locate(a.tables), CORE | BILINGUAL))
    if a.command == "counts":
        s.call("counts").show(truncate=False)
    elif a.command == "fuzzy":
        s.call("fuzzy", queries=spark.createDataFrame([(q.lower(),) for q in a.queries], "q string")).show(truncate=False)
    else:
        s.call(a.command, queries=spark.createDataFrame([(q, a.mode) for q in a.queries], "raw string, mode string")).show(truncate=False)


if __name__ == "__main__":
    main()
