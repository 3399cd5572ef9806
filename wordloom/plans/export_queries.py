"""Queries of readers, kept tables, exports, batches and reports.

Readers and writers go round trip: a table is written in the shared folder in a source's own format, read back by its reader and
compared with the table itself.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import batches as B
from wordloom.operators import bilingual as V
from wordloom.operators import corpus as C
from wordloom.operators import export as E
from wordloom.operators import nested as N
from wordloom.operators import quality as Q
from wordloom.operators import relational as R
from wordloom.operators import reports as P
from wordloom.operators import service as S
from wordloom.operators import tables as K
from wordloom.operators import versions as X
from wordloom.plans.corpus_queries import WITH, docs, ranks, table
from wordloom.sources import readers as I


def folder(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{K.shared_folder(spark)}/round-trip-{uuid4().hex}"


def frequency_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01: a CSV with quoted commas, of which four columns are read."""
    at = folder(spark)
    p = table(spark, d, "part").selectExpr("p_name || ', \"' || p_partkey || '\"' AS word", "p_type AS phonetic", "'x' AS other", "p_size AS bnc", "p_partkey AS frq")
    p.write.csv(at, header=True, quote='"', escape='"', quoteAll=True)
    return I.frequency_csv(spark, at)


def profile_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02: CSV files whose first name has a byte-order mark."""
    at = folder(spark)
    p = table(spark, d, "part").selectExpr("p_name AS `﻿headword`", "p_type AS pos", "p_size AS CEFR")
    p.write.csv(f"{at}/a", header=True)
    p.write.csv(f"{at}/b", header=True)
    return I.profile_csv(spark, f"{at}/a", f"{at}/b").groupBy("headword", "pos", "CEFR").agg(F.count("*").alias("n"))


def sentence_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-06, SRC-10: tab-separated sentences of one language and their links, as pairs of turns."""
    at = folder(spark)
    c = table(spark, d, "conversations").where("NOT contains(text, '\t')").withColumn("text", F.translate("text", "\n\r", "  "))
    c.select(F.concat_ws("\t", F.concat_ws(":", "conv_id", "turn"), F.when(F.col("turn") % 2 == 0, "eng").otherwise("vie"), "text")).write.text(f"{at}/sentences")
    c.select(F.concat_ws("\t", F.concat_ws(":", "conv_id", F.col("turn") + 1), F.concat_ws(":", "conv_id", "turn"))).write.text(f"{at}/links")
    eng, vie = I.sentence_tsv(spark, f"{at}/sentences"), I.sentence_tsv(spark, f"{at}/sentences", "vie")
    return V.sentence_pairs(vie, I.link_tsv(spark, f"{at}/links"), eng)


SENTENCE_SQL = r"""
WITH c AS (SELECT conv_id, turn, translate(text, chr(10) || chr(13), '  ') AS text FROM conversations WHERE NOT contains(text, chr(9)))
SELECT a.conv_id || ':' || a.turn AS eng_id, a.text AS en, min(b.text) AS vi FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0 AND b.turn % 2 = 1 AND length(a.text) <= 120 GROUP BY ALL
"""


def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-07, SRC-08, SET-10, T14: JSON articles of the main name space and tab-separated sentences as one corpus."""
    at = folder(spark)
    docs(spark, d).selectExpr("text", "cast(doc_id % 3 AS int) AS namespace").write.json(f"{at}/articles")
    table(spark, d, "benchmark").select(F.concat_ws("\t", "item_id", F.lit("eng"), F.translate("text", "\n\t", "  "))).write.text(f"{at}/tatoeba")
    return I.corpora(spark, {"tatoeba": f"{at}/tatoeba", "wiki": f"{at}/articles"}).groupBy("source", "priority").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("letters"))


CORPUS_SQL = WITH + r"""
SELECT 'tatoeba' AS source, 0 AS priority, count(*) AS n, sum(length(text))::BIGINT AS letters FROM benchmark
UNION ALL SELECT 'wiki', 1, count(*), sum(length(sentence))::BIGINT FROM trimmed WHERE doc_id % 3 = 0 AND length(sentence) BETWEEN 20 AND 300
"""


def dictionary_file(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03, O1: JSON lines, gzipped; only lines of a language are parsed."""
    at = folder(spark)
    part = table(spark, d, "part")
    line = F.concat(F.lit('{"word": "'), "p_name", F.lit('", "lang_code": "'), F.when(F.col("p_size") % 4 == 0, "fr").otherwise("en"), F.lit('", "pos": "noun", "senses": [{"glosses": ["'), "p_type", F.lit('"]}], "sounds": [{"ipa": "/x/"}]}'))
    part.select(line).write.option("compression", "gzip").text(at)
    return I.dictionary(spark, at).select("word", "lang_code", F.col("senses")[0]["glosses"][0].alias("gloss"), F.col("sounds")[0]["ipa"].alias("ipa")).groupBy("word", "lang_code", "gloss", "ipa").agg(F.count("*").alias("n"))


def result_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-21, SRC-22, NST-06: model results as JSON inside other text, one file each."""
    at = folder(spark)
    body = F.concat(F.lit('Here: {"meta": {"model": "m'), "r_regionkey", F.lit('"}, "result": {"entries": [{"word": "'), "r_name", F.lit('", "pos": "noun", "senses": [{"src": [1, 2], "definition": "d", "vi_ok": true}]}]}} done'))
    table(spark, d, "region").repartition(5, "r_regionkey").select("r_regionkey", body.alias("value")).write.partitionBy("r_regionkey").text(at)
    return I.results(spark, f"{at}/*").select("word", "pos", "model", F.col("senses")[0]["src"][1].alias("second"), F.col("senses")[0]["definition"].alias("definition"))


def word_net(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09, VAR-16, JOIN-17: a zipped word net of nations and regions, its members read and joined."""
    import json

    from wordloom.operators.lexicon import thesaurus

    # A dimension of 25 rows goes into one archive.
    n, r = table(spark, d, "nation").collect(), table(spark, d, "region").collect()
    links = {x.n_name: {"n": {"sense": [{"synset": f"n{x.n_nationkey}"}]}} for x in n}
    sets = {f"n{x.n_nationkey}": {"members": [x.n_name, "land"], "definition": ["a nation"], "hypernym": [f"r{x.n_regionkey}"]} for x in n} | {f"r{x.r_regionkey}": {"members": [x.r_name], "definition": ["a region"]} for x in r}
    data = E.zipped({"entries-a.json": json.dumps(links).encode(), "noun.json": json.dumps(sets).encode(), "read.me": b"x"})
    at = folder(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{at}/net.zip")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    found, synsets = I.word_net(spark, f"{at}/net.zip")
    return thesaurus(found, synsets).select("word", "definition", F.array_join("members", ",").alias("members"), F.array_join("hypernyms", ",").alias("hypernyms"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11, SRC-13, SRC-14: a catalogue of sources, checksums of written files and those that differ from a lock."""
    at = folder(spark)
    toml = "".join(f'[[source]]\nid = "s{i}"\nname = "S {i}"\nlicense = "CC0"\n' for i in range(3))
    table(spark, d, "nation").coalesce(1).orderBy("n_nationkey").select("n_name").write.text(at)
    sums = I.checksums(spark, f"{at}/part-*").select("length", "sha256")
    have = I.catalogue(spark, toml).select("id", "name", "license").crossJoin(F.broadcast(sums.limit(1)))
    lock = have.where("id <> 's1'").select("id", "sha256").union(have.where("id = 's1'").select("id", F.lit("old")))
    return have.join(I.stale_sources(have, lock).select("id", F.lit(True).alias("stale")), "id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


CATALOGUE_SQL = """
WITH t AS (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS body FROM nation)
SELECT 's' || i AS id, 'S ' || i AS name, 'CC0' AS license, length(body)::BIGINT AS length, sha256(body) AS sha256, i = 1 AS stale FROM t, range(3) r(i)
"""


def kept_tables(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01..08, SRC-15, SRC-16, LKP-11: tables written in their schemas, opened again and counted."""
    at = folder(spark)
    o = table(spark, d, "orders")
    given = {
        "meta": spark.createDataFrame([("schema_version", K.SCHEMA_VERSION)], "key string, value string"),
        "headword": table(spark, d, "customer").selectExpr("c_name AS word", "lower(c_name) AS norm", "c_custkey AS freq_rank", "'A' AS tier", "1 AS extra"),
        "entry": o.selectExpr("o_orderkey AS id", "o_orderstatus AS pos", "cast(o_custkey AS string) AS headword"),
    }
    schemas = {k: v for k, v in K.CORE.items() if k in given}
    K.write_tables(given, at, schemas)
    K.write_tables({"headword": given["headword"].where("freq_rank % 2 = 0")}, at, schemas)
    found = K.open_tables(spark, at, schemas)
    counts = Q.table_counts(found)
    missing = found["entry"].agg(F.lit("entry without tier").alias("table"), F.count_if(F.expr("tier IS NULL AND id IS NOT NULL")).alias("n"))
    return counts.unionByName(missing)


KEPT_SQL = """
SELECT 'meta' AS "table", 1::BIGINT AS n UNION ALL SELECT 'headword', count_if(c_custkey % 2 = 0) FROM customer UNION ALL SELECT 'entry', count(*) FROM orders UNION ALL SELECT 'entry without tier', count(*) FROM orders
"""


def user_tables(spark: SparkSession, d: str) -> DataFrame:
    """USR-11..14: a user's tables saved and opened again: one is missing, one lacks a column, one can't be read."""
    at = folder(spark)
    e = table(spark, d, "events")
    S.save_user_state({"history": e.selectExpr("event_id AS id", "event_type AS key", "'l' AS label", "'k' AS kind", "user_id AS ts")}, at)
    e.selectExpr("user_id AS id", "event_type AS name").distinct().write.parquet(f"{at}/wordlist")
    e.selectExpr("event_type AS value").write.text(f"{at}/settings")
    return Q.table_counts(S.open_user_state(spark, at))


USER_SQL = """
SELECT 'history' AS "table", count(*) AS n FROM events UNION ALL SELECT 'wordlist', count(*) FROM (SELECT DISTINCT user_id, event_type FROM events) UNION ALL SELECT 'wordlist_item', 0 UNION ALL SELECT 'settings', 0
"""


def shard_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18, SNK-15, SNK-16, VAR-26, VAR-27: shards written as files; a word's shard is read alone."""
    at = folder(spark)
    E.write_shards(E.shards(table(spark, d, "customer").selectExpr("c_name AS word", "c_nationkey", "c_mktsegment"), "word", 16), at)
    one = lambda w: E.read_shard(spark, at, w, 16).select(F.lit(w).alias("word"), F.get_json_object("value", f"$['{w}'].c_nationkey").cast("int").alias("nation"), F.size(F.json_object_keys("value")).alias("entries"))
    return one("Customer#000000001").unionByName(one("Customer#000000077"))


SHARD_FILES_SQL = """
WITH h AS (SELECT *, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) % 16)::INT AS shard FROM customer)
SELECT c_name AS word, c_nationkey AS nation, (SELECT count(*) FROM h b WHERE b.shard = a.shard)::INT AS entries FROM h a WHERE c_custkey IN (1, 77)
"""


def package(spark: SparkSession, d: str) -> DataFrame:
    """SNK-17, SNK-22, FLT-33, VAR-21, VAR-33: a version of pages as files, those beyond the limits, and the versions that stay."""
    files = table(spark, d, "pages").select(F.concat("page_id", F.when(F.col("page_id") % 9 == 0, ".exe").otherwise(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    version = E.version_id(files).select(F.lit("version").alias("part"), F.col("version").alias("name"))
    over = E.oversized(files).select(F.lit("over").alias("part"), F.col("path").alias("name"))
    kept = E.kept_versions(table(spark, d, "orders").selectExpr("o_orderkey AS version", "o_orderdate AS created"), 3).select(F.lit("kept").alias("part"), F.col("version").cast("string").alias("name"))
    stale = spark.range(1).select(F.lit("stale").alias("part"), F.lit(str(S.is_stale("2", "1")) + str(S.is_stale("2", "2"))).alias("name"))
    return version.unionByName(over).unionByName(kept).unionByName(stale)


def package_changes(spark: SparkSession, d: str) -> DataFrame:
    """SNK-17, VAR-33: two versions of pages as files, kept by ranges of names: what was added, removed and changed, read from the ranges that differ."""
    p = table(spark, d, "pages").select("page_id", F.concat("page_id", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    old = p.where("page_id % 50 <> 1")
    new = p.where("page_id % 60 <> 2").withColumn("content", F.when(F.col("page_id") % 70 == 3, F.encode(F.lit("new"), "UTF-8")).otherwise(F.col("content")))
    kept = []
    for df in (old, new):
        at = folder(spark)
        X.in_ranges(df.select("path", "content"), 2).write.partitionBy("range").parquet(at)
        kept.append(spark.read.schema("path string, content binary, range string").parquet(at))
    trees = [K.cut(X.tree(df, 2)) for df in kept]
    return X.changes(*kept, X.changed_ranges(*trees, 2))


CHANGES_SQL = """
SELECT page_id || '.html' AS path, CASE WHEN page_id % 50 = 1 THEN 'added' WHEN page_id % 60 = 2 THEN 'removed' ELSE 'changed' END AS change FROM pages
WHERE NOT (page_id % 50 = 1 AND page_id % 60 = 2) AND (page_id % 50 = 1 OR page_id % 60 = 2 OR (page_id % 70 = 3 AND html <> 'new'))
"""


PACKAGE_SQL = """
WITH f AS (SELECT page_id || CASE WHEN page_id % 9 = 0 THEN '.exe' ELSE '.html' END AS path, html FROM pages),
l AS (SELECT path || chr(0) || sha256(html) AS line FROM f)
SELECT 'version' AS part, sha256(string_agg(line, chr(10) ORDER BY line)) AS name FROM l
UNION ALL SELECT 'over', path FROM f WHERE path LIKE '%.exe'
UNION ALL SELECT 'kept', o_orderkey::VARCHAR FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3)
UNION ALL SELECT 'stale', 'TrueFalse'
"""


def batch_state(spark: SparkSession, d: str) -> DataFrame:
    """BAT-04, BAT-10, BAT-12, AGG-31, JOIN-25: planned words, progress, what is pending and what wasn't answered, of orders as batches."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    plan = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("words"), F.min("l_partkey").alias("rank_first"))
    words = B.planned_words(plan).groupBy(F.lit("word").alias("part"), F.col("at").cast("string").alias("name")).agg(F.count("*").cast("double").alias("n"))
    results = o.selectExpr("o_orderkey AS id", "o_orderstatus <> 'P' AS ok", "unix_seconds(cast(o_orderdate AS timestamp)) AS finished").where("id % 5 <> 0")
    progress = P.batch_progress(plan, results).selectExpr("stack(4, 'planned', cast(planned AS double), 'done', cast(done AS double), 'failed', cast(failed AS double), 'per_hour', round(per_hour, 6)) AS (name, n)").select(F.lit("progress").alias("part"), "name", "n")
    pending = B.pending(results.where("NOT ok").select("id"), plan.select("id")).agg(F.lit("pending").alias("part"), F.lit("batches").alias("name"), F.count("*").cast("double").alias("n"))
    sent = li.groupBy(F.col("l_partkey").cast("string").alias("word"), F.col("l_returnflag").alias("pos")).agg(F.count("*").alias("n"))
    answered = li.where("l_quantity > 20").groupBy(F.col("l_partkey").cast("string").alias("word"), F.col("l_returnflag").alias("pos")).agg(F.count("*").alias("n"))
    gaps = B.gaps(sent, answered).groupBy(F.lit("gap").alias("part"), F.col("pos").alias("name")).agg(F.sum(F.col("n") - F.col("answered")).cast("double").alias("n"))
    texts = C.with_texts(R.top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 1).select("o_orderkey"), li.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), ["o_orderkey"]).agg(F.lit("texts").alias("part"), F.lit("quantity").alias("name"), F.sum("l_quantity").alias("n"))
    return words.unionByName(progress).unionByName(pending).unionByName(gaps).unionByName(texts)


BATCH_SQL = """
WITH s AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey::VARCHAR) AS words FROM lineitem GROUP BY 1), a AS (SELECT unnest(range(0, len(words))) AS i FROM s),
r AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS ok, epoch(o_orderdate)::BIGINT AS t FROM orders WHERE o_orderkey % 5 <> 0), j AS (SELECT s.id, ok, t FROM s LEFT JOIN r USING (id)),
g AS (SELECT l_returnflag AS name, count(*) - count_if(l_quantity > 20) AS n FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1)
SELECT 'word' AS part, i::VARCHAR AS name, count(*)::DOUBLE AS n FROM a GROUP BY i
UNION ALL SELECT 'progress', unnest(['planned', 'done', 'failed', 'per_hour']), unnest([count(*)::DOUBLE, count_if(ok)::DOUBLE, count_if(NOT ok)::DOUBLE, round(3600 * count_if(ok) / greatest(1, max(t) - min(t)), 6)]) FROM j
UNION ALL SELECT 'pending', 'batches', count(*) FROM r WHERE NOT ok AND id NOT IN (SELECT id FROM s)
UNION ALL SELECT 'gap', name, n FROM g
UNION ALL SELECT 'texts', 'quantity', sum(l_quantity) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM b)
"""


def grouped_usage(spark: SparkSession, d: str) -> DataFrame:
    """NST-09, NST-10, VAR-36..38, VAR-40, VAR-47, SET-08, JOIN-18: groups in fixed order, sections, engines side by side, kept examples."""
    o = table(spark, d, "orders")
    rows = o.selectExpr("o_custkey AS headword", "element_at(array('noun', 'verb', 'adj', 'adv'), cast(o_orderkey % 4 AS int) + 1) AS pos", "element_at(array('plural', 'base', 'subject', 'initial', 'comparative'), cast(o_orderkey % 5 AS int) + 1) AS code", "o_orderkey AS n", "o_orderpriority AS prep", "o_orderstatus AS obj")
    groups = P.grouped_in_order(rows, P.dimension(spark, P.ROLES), "code", ["n"], ["n"]).select(F.lit("groups").alias("part"), F.col("headword").cast("string").alias("word"), F.array_join(F.transform("groups", lambda g: F.concat_ws(":", g["pos"], g["code"], F.size(g["rows"]))), ",").alias("what"))
    preps = P.preposition_groups(rows).select(F.lit("preps").alias("part"), F.col("headword").cast("string").alias("word"), F.array_join(F.transform("groups", lambda g: F.concat_ws(":", g["pos"], g["preps"][0]["n"], F.size(g["preps"]))), ",").alias("what"))
    engines = P.by_engine(rows.selectExpr("obj AS word", "prep AS model", "pos", "n AS senses").where("n % 100 = 0")).select(F.lit("engines").alias("part"), "word", F.array_join(F.transform("results", lambda x: F.concat_ws(":", x["model"], x["pos"])), ",").alias("what"))
    counts = rows.groupBy("headword").agg(F.count_if(F.expr("pos = 'noun'")).alias("a"), F.count_if(F.expr("pos = 'verb'")).alias("b"), F.count_if(F.expr("n % 3 = 0")).alias("c"))
    sections = counts.select(F.lit("sections").alias("part"), F.col("headword").cast("string").alias("word"), F.array_join(N.sections(nouns=F.col("a"), verbs=F.col("b"), thirds=F.col("c")), ",").alias("what"))
    ants = P.antonyms(o.selectExpr("o_orderkey AS entry_id", "o_orderpriority AS word"), o.selectExpr("o_orderkey AS id", "o_orderstatus AS headword")).select(F.lit("antonym").alias("part"), F.col("headword").alias("word"), F.col("word").alias("what"))
    ex = o.selectExpr("o_orderstatus AS headword", "'v' AS pos", "CASE WHEN o_orderkey % 3 = 0 THEN 'coll' ELSE 'role' END AS kind", "o_orderpriority || '|' || (o_orderkey % 4) AS key")
    kept = P.kept_collocation_examples(ex, o.where("o_orderkey % 7 = 0 AND o_totalprice > 200000").selectExpr("o_orderstatus AS headword", "'v' AS pos", "o_orderpriority AS pattern", "o_orderkey % 4 AS display"))
    shown = kept.groupBy(F.lit("kept").alias("part"), F.col("headword").alias("word")).agg(F.count("*").cast("string").alias("what"))
    return groups.unionByName(preps).unionByName(engines).unionByName(sections).unionByName(ants).unionByName(shown)


_ROLE_ROWS = ", ".join(f"('{p}', '{c}', {i})" for p, cs in P.ROLES.items() for i, c in enumerate(cs))
GROUPED_SQL = f"""
WITH r AS (SELECT o_custkey AS headword, ['noun', 'verb', 'adj', 'adv'][o_orderkey % 4 + 1] AS pos, ['plural', 'base', 'subject', 'initial', 'comparative'][o_orderkey % 5 + 1] AS code, o_orderkey AS n, o_orderpriority AS prep, o_orderstatus AS obj FROM orders),
dim(pos, code, ord) AS (VALUES {_ROLE_ROWS}),
g AS (SELECT headword, pos, code, ord, count(*) AS k FROM r JOIN dim USING (pos, code) GROUP BY ALL),
q AS (SELECT headword, pos, max(n) AS top, count(*) AS k FROM r GROUP BY ALL),
s AS (SELECT headword, count_if(pos = 'noun') AS a, count_if(pos = 'verb') AS b, count_if(n % 3 = 0) AS c FROM r GROUP BY 1),
e AS (SELECT obj AS headword, CASE WHEN n % 3 = 0 THEN 'coll' ELSE 'role' END AS kind, prep || '|' || n % 4 AS key FROM r),
t AS (SELECT DISTINCT o_orderstatus AS headword, o_orderpriority || '|' || o_orderkey % 4 AS key FROM orders WHERE o_orderkey % 7 = 0 AND o_totalprice > 200000)
SELECT 'groups' AS part, headword::VARCHAR AS word, string_agg(pos || ':' || code || ':' || k, ',' ORDER BY pos, ord) AS what FROM g GROUP BY headword
UNION ALL SELECT 'preps', headword::VARCHAR, string_agg(pos || ':' || top || ':' || k, ',' ORDER BY list_position(['verb', 'noun', 'adj', 'adv'], pos)) FROM q GROUP BY headword
UNION ALL SELECT 'engines', obj, string_agg(prep || ':' || pos, ',' ORDER BY prep, pos) FROM r WHERE n % 100 = 0 GROUP BY obj
UNION ALL SELECT 'sections', headword::VARCHAR, concat_ws(',', CASE WHEN a > 0 THEN 'nouns' END, CASE WHEN b > 0 THEN 'verbs' END, CASE WHEN c > 0 THEN 'thirds' END) FROM s
UNION ALL SELECT DISTINCT 'antonym', obj, prep FROM r
UNION ALL SELECT 'kept', headword, count(*)::VARCHAR FROM e WHERE kind <> 'coll' OR (headword, key) IN (SELECT (headword, key) FROM t) GROUP BY headword
"""


def release_checks(spark: SparkSession, d: str) -> DataFrame:
    """VAR-24, SNK-23, SNK-25: invariants of a release, a bundle of small entries and a report's section."""
    o = table(spark, d, "orders")
    sense = o.selectExpr("o_orderkey AS id", "o_custkey AS entry_id", "o_orderstatus = 'P' AS is_ai", "CASE WHEN o_orderkey % 2 = 0 THEN 'learner' ELSE 'full' END AS layer")
    entry = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN 'm' END AS ai_model")
    example = o.selectExpr("o_orderkey AS sense_id", "o_orderkey % 5 = 0 AS is_ai")
    source = table(spark, d, "nation").selectExpr("CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'CC0' END AS license")
    rules = Q.invariants(sense, entry, example, source).select("rule", F.col("n").cast("string").alias("what"))
    n = table(spark, d, "nation").selectExpr("n_name AS word", "n_nationkey AS freq_rank", "named_struct('uk', '/u/') AS ipa", "array(n_regionkey) AS blocks")
    document = P.bundle(n).select(F.lit("bundle").alias("rule"), F.concat_ws("|", F.size(F.json_object_keys("document")), F.get_json_object("document", "$.NATION_7")).alias("what"))
    report = P.markdown_table(P.totals_by(P.counts_by(table(spark, d, "nation"), "n_regionkey"), "n_regionkey"), "Nations")
    return rules.unionByName(document).unionByName(spark.createDataFrame([("report", report)], "rule string, what string"))


CHECKS_SQL = """
SELECT 'ai sense without model' AS rule, count_if(o_orderstatus = 'P' AND o_custkey % 2 = 1)::VARCHAR AS what FROM orders
UNION ALL SELECT 'ai example outside the learner layer', count_if(o_orderkey % 5 = 0 AND o_orderkey % 2 = 1)::VARCHAR FROM orders
UNION ALL SELECT 'source without licence', count_if(n_nationkey % 4 = 0)::VARCHAR FROM nation
UNION ALL SELECT 'bundle', count(*) || '|{"freq_rank":7,"ipa":{"uk":"/u/"},"blocks":[' || max(n_regionkey) FILTER (n_nationkey = 7) || ']}' FROM nation
UNION ALL SELECT 'report', '## Nations' || chr(10) || chr(10) || '| n_regionkey | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_regionkey || ' | ' || n || ' |', chr(10) ORDER BY n DESC, n_regionkey) || chr(10) FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)
"""


def kept_candidates(spark: SparkSession, d: str) -> DataFrame:
    """WIN-07: customers' dearest orders of each status: eight, three or one by kind."""
    o = table(spark, d, "orders").selectExpr("o_custkey % 50 AS lemma", "'v' AS pos", "element_at(array('role', 'prep', 'seq'), cast(o_orderkey % 3 AS int) + 1) AS kind", "o_orderstatus AS key", "o_totalprice AS score", "cast(o_orderkey AS string) AS sentence")
    return C.kept_candidates(o).select("lemma", "kind", "key", "sentence", "place")


CANDIDATES_SQL = """
SELECT lemma, kind, key, sentence, place FROM (
  SELECT o_custkey % 50 AS lemma, ['role', 'prep', 'seq'][o_orderkey % 3 + 1] AS kind, o_orderstatus AS key, o_orderkey::VARCHAR AS sentence,
    row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 3, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS place FROM orders) WHERE place <= CASE kind WHEN 'role' THEN 8 WHEN 'prep' THEN 3 ELSE 1 END
"""


def rare_tags(spark: SparkSession, d: str) -> DataFrame:
    """FLT-16, FLT-17, T24: parts of speech that are a small share of a word's, of words by their endings."""
    r = ranks(spark, d).select(F.substring("word", 1, 2).alias("lemma"), F.substring("word", -1, 1).alias("pos"), "n").groupBy("lemma", "pos").agg(F.sum("n").alias("n"))
    return C.rare_pos(r)


RARE_SQL = WITH + """
, c AS (SELECT substr(word, 1, 2) AS lemma, right(word, 1) AS pos, sum(n) AS n FROM ranks GROUP BY ALL)
SELECT lemma, pos FROM (SELECT *, sum(n) OVER (PARTITION BY lemma) AS t FROM c) WHERE t >= 50 AND n / t < 0.05
"""

QUERIES = {
    "frequency_file": (frequency_file, "SELECT p_name || ', \"' || p_partkey || '\"' AS word, p_type AS phonetic, p_size::VARCHAR AS bnc, p_partkey::VARCHAR AS frq FROM part"),
    "profile_files": (profile_files, 'SELECT p_name AS headword, p_type AS pos, p_size::VARCHAR AS "CEFR", 2 * count(*) AS n FROM part GROUP BY ALL'),
    "sentence_files": (sentence_files, SENTENCE_SQL),
    "corpus_files": (corpus_files, CORPUS_SQL),
    "dictionary_file": (dictionary_file, "SELECT p_name AS word, 'en' AS lang_code, p_type AS gloss, '/x/' AS ipa, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY ALL"),
    "result_files": (result_files, "SELECT r_name AS word, 'noun' AS pos, 'm' || r_regionkey AS model, 2 AS second, 'd' AS definition FROM region"),
    "word_net": (word_net, "SELECT n_name AS word, 'a nation' AS definition, 'land' AS members, r_name AS hypernyms FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "catalogue": (catalogue, CATALOGUE_SQL),
    "kept_tables": (kept_tables, KEPT_SQL),
    "user_tables": (user_tables, USER_SQL),
    "shard_files": (shard_files, SHARD_FILES_SQL),
    "package": (package, PACKAGE_SQL),
    "package_changes": (package_changes, CHANGES_SQL),
    "batch_state": (batch_state, BATCH_SQL),
    "grouped_usage": (grouped_usage, GROUPED_SQL),
    "release_checks": (release_checks, CHECKS_SQL),
    "kept_candidates": (kept_candidates, CANDIDATES_SQL),
    "rare_tags": (rare_tags, RARE_SQL),
}
