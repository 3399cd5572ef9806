"""The operators' relational forms on the star schema, events and documents, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import corpus as C
from wordloom.operators import lexicon as X
from wordloom.operators import nested as N
from wordloom.operators import quality as Q
from wordloom.operators import relational as R
from wordloom.operators import state as S
from wordloom.operators import bilingual as B
from wordloom.operators import batches as P
from wordloom.plans.corpus_queries import table


def coverage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11, JOIN-01..03: customers as words, orders as entries, open orders as senses, line items as examples."""
    c, o, li = (table(spark, d, x) for x in ("customer", "orders", "lineitem"))
    words = c.select(F.col("c_custkey").alias("word"))
    entry = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("headword"))
    sense = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("entry_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("").alias("definition"), F.when(F.col("o_totalprice") > 300000, "x").alias("vi"))
    return Q.coverage(words, entry, o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("entry_id")), sense, li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("sense_id")), o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("entry_id")))


COVERAGE_SQL = """
WITH f AS (
  SELECT c_custkey,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS entry,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS definition,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS ipa,
    EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R') AS example,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS vi
  FROM customer)
SELECT unnest(['entry', 'definition', 'ipa', 'example', 'vi']) AS metric,
  unnest([round(100 * count_if(entry) / count(*), 1), round(100 * count_if(definition) / count(*), 1), round(100 * count_if(ipa) / count(*), 1),
    round(100 * count_if(example) / count(*), 1), round(100 * count_if(vi) / count(*), 1)]) AS pct FROM f
"""


def gate(spark: SparkSession, d: str) -> DataFrame:
    return Q.gate(coverage_metrics(spark, d))


GATE_SQL = f"""
WITH m AS ({COVERAGE_SQL}), t AS (SELECT unnest(['entry', 'definition', 'ipa', 'example', 'vi']) AS metric, unnest([98.0, 98.0, 95.0, 90.0, 85.0])::DOUBLE AS least)
SELECT metric, pct, least, pct >= least AS ok FROM t LEFT JOIN m USING (metric)
"""


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05, WIN-13: each customer's three dearest orders."""
    return R.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, "place").select("o_custkey", "o_orderkey", "place")


def budget_cut(spark: SparkSession, d: str) -> DataFrame:
    """WIN-08, WIN-09: lines of an order until 100 pieces are taken."""
    return R.running_budget(table(spark, d, "lineitem"), ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")], "l_quantity", 100).select("l_orderkey", "l_linenumber", "l_partkey", "taken")


BUDGET_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity, 100 - before) AS taken FROM (
  SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem)
WHERE before < 100 AND l_quantity > 0
"""


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """WIN-10: parts before and after each part of a brand by name."""
    out = R.neighbours(table(spark, d, "part"), ["p_brand"], [F.asc("p_name"), F.asc("p_partkey")], "p_partkey")
    return out.select("p_partkey", F.array_join(F.col("before").cast("array<string>"), ",").alias("before"), F.array_join(F.col("after").cast("array<string>"), ",").alias("after"))


NEIGHBOURS_SQL = """
SELECT p_partkey, array_to_string(coalesce(list(p_partkey) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []), ',') AS before,
  array_to_string(coalesce(list(p_partkey) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), []), ',') AS after
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_name, p_partkey)
"""


def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """WIN-12, SRC-21, USR-10: each user's last event of each kind."""
    return R.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


def history_upsert(spark: SparkSession, d: str) -> DataFrame:
    """USR-01, USR-02: later events merge into the history of earlier ones; the newest 500 keys stay."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_type").alias("label"), F.lit("event").alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    return S.add_history(e.where("id % 2 = 0"), e.where("id % 2 = 1"))


def history_stream(spark: SparkSession, d: str) -> DataFrame:
    """USR-01, USR-02: events as a bounded stream in three micro-batches, whose keyed state is each user's last visit of every kind."""
    from wordloom.plans.export_queries import folder
    from wordloom.streaming import keyed

    e = table(spark, d, "events").select(F.col("user_id").cast("bigint").alias("user_id"), F.col("event_type").alias("key"), F.concat(F.lit("visit "), "event_type").alias("label"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    at = folder(spark)
    e.repartition(3).write.parquet(f"{at}/in")
    keyed.follow(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint")
    return keyed.history(spark, f"{at}/out").select("user_id", "key", F.unix_micros("ts").alias("micros"), "id", "visits")


STREAM_SQL = """
SELECT user_id::BIGINT AS user_id, event_type AS key, epoch_us(max(ts)) AS micros, arg_max(event_id, (ts, event_id)) AS id, count(*) AS visits FROM events GROUP BY user_id, event_type
"""


HISTORY_SQL = """
WITH e AS (SELECT event_id AS id, user_id::VARCHAR || ':' || event_type AS key, event_type AS label, 'event' AS kind, epoch(ts)::BIGINT AS ts FROM (SELECT *, date_trunc('second', ts) AS s FROM events)),
f AS (SELECT event_id AS id, user_id::VARCHAR || ':' || event_type AS key, event_type AS label, 'event' AS kind, epoch(date_trunc('second', ts))::BIGINT AS ts FROM events)
SELECT id, key, label, kind, ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS n FROM f) WHERE n = 1 ORDER BY ts DESC, id DESC LIMIT 500
"""


def left_join_count(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-08: customers with their number of orders."""
    return S.list_counts(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, d, "orders").select(F.col("o_custkey").alias("list_id")))


def anti_semi(spark: SparkSession, d: str) -> DataFrame:
    """SET-04, VAR-46: parts that lines of 1996 on name and lines before don't."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate")
    return R.set_difference(table(spark, d, "part").join(li.where("l_shipdate >= '1996-01-01'"), "p_partkey", "left_semi"), li.where("l_shipdate < '1996-01-01'"), ["p_partkey"]).select("p_partkey", "p_name")


def run_grouping(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26: turns of one speaker in a row."""
    return R.runs(table(spark, d, "conversations"), ["conv_id"], [F.asc("turn"), F.asc("text")], "role").groupBy("conv_id", "run", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("letters"))


RUN_SQL = """
WITH l AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT conv_id, run, role, count(*) AS turns, sum(length(text)) AS letters FROM r GROUP BY ALL
"""


def nested_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = N.packed(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_partkey", "l_quantity", "l_returnflag"], "lines")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).drop("l_orderkey")


def nested_assembly(spark: SparkSession, d: str) -> DataFrame:
    """AGG-25: orders inside customers and lines inside orders, flattened again with their places."""
    view = N.packed(nested_orders(spark, d), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "lines"], "orders")
    flat = view.select("o_custkey", F.posexplode("orders").alias("o_place", "o")).select("o_custkey", "o_place", F.posexplode("o.lines").alias("l_place", "l"))
    return flat.select("o_custkey", "o_place", "l_place", "l.l_partkey", "l.l_quantity")


NESTED_SQL = """
SELECT o_custkey, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS o_place, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS l_place, l_partkey, l_quantity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
"""


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """NST-16, SNK-19, VAR-42: one quoted line for each order."""
    text = lambda x: F.concat_ws(" ", x["l_returnflag"], x["l_partkey"])
    return nested_orders(spark, d).select("o_orderkey", N.csv_line("o_orderstatus", N.numbered_text(F.col("lines"), text), F.concat_ws(", ", F.transform("lines", lambda x: x["l_returnflag"]))).alias("line"))


CSV_SQL = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem),
g AS (
  SELECT o_orderkey, o_orderstatus, string_agg(CASE WHEN c = 1 THEN '' ELSE k || '. ' END || l_returnflag || ' ' || l_partkey, '; ' ORDER BY k) AS a, string_agg(l_returnflag, ', ' ORDER BY k) AS b
  FROM orders JOIN n ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey, o_orderstatus || ',' || a || ',' || CASE WHEN contains(b, ',') THEN '"' || b || '"' ELSE b END AS line FROM g
"""


def json_validate(spark: SparkSession, d: str) -> DataFrame:
    """Extra: the number in an event's properties, or a reason why there is none."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(F.col("props").isNull(), "no properties").when(k.isNull(), "no number").when(~k.between(1, 50), "out of range").otherwise("good").alias("state"))


JSON_SQL = """
SELECT event_id, k, CASE WHEN props IS NULL THEN 'no properties' WHEN k IS NULL THEN 'no number' WHEN k NOT BETWEEN 1 AND 50 THEN 'out of range' ELSE 'good' END AS state
FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)
"""


def percentile_sizes(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21, VAR-21, VAR-22."""
    return Q.sizes(table(spark, d, "documents"), ["lang"], "n_chars", (0.5, 0.95))


SIZES_SQL = """
SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS total, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS most FROM documents GROUP BY lang
"""


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-29: per source what its documents have."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.count("quality").alias("labelled"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("any_toxic"), Q.stored_bytes(F.col("text")).alias("bytes"))


STATS_SQL = """
SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, count(quality) AS labelled, bool_or(coalesce(toxic = 1, false)) AS any_toxic, sum(octet_length(encode(text)) + 30)::BIGINT AS bytes
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
"""


def distinct_words(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15: distinct words of parts' names, types and brands, and of all together."""
    p = table(spark, d, "part")
    return X.distinct_words(p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")), p.select(F.lower("p_type").alias("word")), p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).union(p.select("p_brand")))


DISTINCT_SQL = """
WITH w AS (SELECT '0' AS source, unnest(string_split(lower(p_name), ' ')) AS word FROM part UNION ALL SELECT '1', lower(p_type) FROM part UNION ALL SELECT '2', unnest(string_split(lower(p_name), ' ')) FROM part UNION ALL SELECT '2', p_brand FROM part)
SELECT source, count(DISTINCT word) AS n FROM w GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT word) FROM w
"""


def coverage_cuts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, WIN-01: customers ranked by balance; how many of the first have orders and urgent orders."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    ranks = R.global_rank(c.select(F.col("c_custkey").alias("word"), "c_acctbal"), [F.desc("c_acctbal"), F.asc("word")]).select("word", "freq_rank")
    per = o.groupBy(F.col("o_custkey").alias("word")).agg(F.lit(True).alias("has_order"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    out = X.coverage_at(per, ranks, ["has_order", "urgent"], [50, 100, 500])
    return out.select("cut", "words", F.round("has_order", 6).alias("has_order"), F.round("urgent", 6).alias("urgent"))


CUTS_SQL = """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS freq_rank FROM customer),
p AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1)
SELECT cut, count(*) AS words, round(avg((o_custkey IS NOT NULL)::INT), 6) AS has_order, round(avg(coalesce(urgent, false)::INT), 6) AS urgent
FROM (SELECT unnest([50, 100, 500]) AS cut), r LEFT JOIN p ON o_custkey = c_custkey WHERE freq_rank <= cut GROUP BY cut
"""


def jaccard_match(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-09, STR-18: for each part type of a brand, the part whose name shares most words with it."""
    p = table(spark, d, "part")
    senses = p.select(F.col("p_brand").alias("entry_id"), F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", "p_type").alias("gloss"))
    heads = p.select(F.col("p_brand").alias("entry_id"), F.col("p_type").alias("header"), F.col("p_name").alias("word"), F.col("p_partkey").alias("place"))
    return X.matched_translations(senses, heads, 0.25).select("entry_id", "header", F.size("words").alias("n"), "ord")


_TOKS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z]+'), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.GLOSS_STOP) + ")))"
JACCARD_SQL = f"""
WITH h AS (SELECT p_brand AS entry_id, p_type AS header, count(*) AS n, {_TOKS.format('p_type')} AS a FROM part GROUP BY p_brand, p_type),
s AS (SELECT p_brand AS entry_id, p_partkey AS ord, {_TOKS.format("p_name || ' ' || p_type")} AS b FROM part),
j AS (SELECT h.entry_id, header, n, ord, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END AS score FROM h JOIN s ON h.entry_id = s.entry_id),
best AS (SELECT entry_id, header, ord FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, header ORDER BY score DESC, ord) AS k FROM j WHERE score >= 0.25) WHERE k = 1)
SELECT h.entry_id, h.header, h.n::INT AS n, ord FROM h LEFT JOIN best ON best.entry_id = h.entry_id AND best.header = h.header
"""


def relation_lift(spark: SparkSession, d: str) -> DataFrame:
    """A plain form of AGG-05's lift: how much more often than all users a user has a kind of event."""
    e = table(spark, d, "events")
    pairs = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 3")
    occ, kind = e.groupBy("user_id").agg(F.count("*").alias("occ")), e.groupBy("event_type").agg(F.count("*").alias("kn"))
    total = e.agg(F.count("*").alias("all"))
    rows = pairs.join(occ, "user_id").join(kind, "event_type").join(F.broadcast(total), F.lit(True))
    return rows.select("user_id", "event_type", "n", F.round(F.col("n") / F.col("occ"), 6).alias("ratio"), F.round(F.col("n") / F.col("occ") / (F.col("kn") / F.col("all")), 6).alias("lift"))


LIFT_SQL = """
WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3), o AS (SELECT user_id, count(*) AS occ FROM events GROUP BY 1), k AS (SELECT event_type, count(*) AS kn FROM events GROUP BY 1)
SELECT user_id, event_type, n, round(n / occ, 6) AS ratio, round(n / occ / (kn / (SELECT count(*) FROM events)), 6) AS lift FROM p JOIN o USING (user_id) JOIN k USING (event_type)
"""


def prep_patterns(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05, AGG-06, FLT-16..18: orders' priorities as prepositions of customers' segments, their status as complements."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.select(F.col("n_name").alias("lemma"), F.when(F.col("c_mktsegment") < "F", "VERB").otherwise("NOUN").alias("pos"), F.col("o_orderpriority").alias("prep"), F.col("o_orderstatus").alias("obj"))
    count = lambda *by: o.groupBy(*by).agg(F.count("*").alias("n"))
    out = C.prep_patterns(count("lemma", "pos", "prep", "obj"), count("lemma", "pos"), count("pos", "prep"), count("pos"))
    return out.select("lemma", "pos", "prep", "obj", "n", F.round("ratio", 6).alias("ratio"), F.round("lift", 6).alias("lift"), "pass", "label")


PREP_SQL = """
WITH o AS (SELECT n_name AS lemma, CASE WHEN c_mktsegment < 'F' THEN 'VERB' ELSE 'NOUN' END AS pos, o_orderpriority AS prep, o_orderstatus AS obj FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
node AS (SELECT lemma, pos, count(*) AS occ FROM o GROUP BY ALL), pp AS (SELECT pos, prep, count(*) AS pn FROM o GROUP BY ALL), pt AS (SELECT pos, count(*) AS tn FROM o GROUP BY ALL),
rare AS (SELECT lemma, pos FROM (SELECT *, sum(occ) OVER (PARTITION BY lemma) AS t FROM node) WHERE t >= 50 AND occ / t < 0.05),
tot AS (SELECT lemma, pos, prep, count(*) AS n FROM o GROUP BY ALL HAVING count(*) >= 5),
ob AS (SELECT *, row_number() OVER (PARTITION BY lemma, pos, prep ORDER BY ov DESC, obj) AS k FROM (SELECT lemma, pos, prep, obj, count(*) AS ov FROM o GROUP BY ALL)),
sh AS (SELECT lemma, pos, prep, string_agg(obj, ' / ' ORDER BY k) AS obj FROM ob JOIN tot USING (lemma, pos, prep) WHERE k <= 3 AND ov >= greatest(2, 0.15 * n) GROUP BY ALL),
r AS (
  SELECT lemma, pos, prep, coalesce(obj, '') AS obj, n, n / occ AS ratio, (n / occ) / (pn / tn) AS lift
  FROM tot JOIN node USING (lemma, pos) JOIN pp USING (pos, prep) JOIN pt USING (pos) LEFT JOIN sh USING (lemma, pos, prep) ANTI JOIN rare USING (lemma, pos)),
q AS (SELECT *, CASE pos WHEN 'NOUN' THEN n >= 8 AND ratio >= 0.010 AND lift >= 2.0 ELSE n >= 8 AND ratio >= 0.015 AND lift >= 2.5 END OR (obj LIKE '%doing%' AND n >= 30 AND ratio >= 0.1 AND lift >= 1.2) AS pass FROM r)
SELECT lemma, pos, prep, obj, n, round(ratio, 6) AS ratio, round(lift, 6) AS lift, pass, CASE WHEN pass THEN CASE WHEN ratio >= 0.2 THEN 'common' ELSE 'less common' END ELSE '' END AS label FROM q
"""


def hypernym_hop(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-17: customers' nations as synsets, their regions as hypernyms."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nations = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.array(F.col("n_name")).alias("members"), F.array(F.concat(F.lit("nation "), "n_name")).alias("definition"), F.array(F.concat(F.lit("r"), "n_regionkey")).alias("hypernym"))
    regions = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.array("r_name").alias("members"), F.array(F.lit("region")).alias("definition"), F.array().cast("array<string>").alias("hypernym"))
    links = table(spark, d, "customer").select(F.col("c_name").alias("word"), F.lit("noun").alias("pos"), F.lit(0).alias("ord"), F.concat(F.lit("n"), "c_nationkey").alias("synset"))
    return X.thesaurus(links, nations.unionByName(regions)).select("word", "definition", F.array_join("members", ",").alias("members"), F.array_join("hypernyms", ",").alias("hypernyms"))


HOP_SQL = """
SELECT c_name AS word, 'nation ' || n_name AS definition, n_name AS members, r_name AS hypernyms FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def grouped_links(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10, SRT-09, T5: parts' suppliers as links of a part."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("vi"), F.col("l_suppkey").alias("headword"), F.col("l_returnflag").alias("pos"), F.lit(None).cast("string").alias("guideword"), F.col("l_linestatus").alias("definition"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("source"), F.col("l_quantity").cast("int").alias("weight"), F.col("l_orderkey").alias("freq_rank"))
    return B.grouped_links(li, 5).select("vi", "headword", "pos", "weight", "freq_rank", "rank")


LINKS_SQL = """
SELECT * FROM (
  SELECT vi, headword, pos, weight, freq_rank, row_number() OVER (PARTITION BY vi ORDER BY weight DESC, freq_rank, headword, pos) AS rank FROM (
    SELECT l_partkey AS vi, l_suppkey AS headword, l_returnflag AS pos, max(l_quantity)::INT AS weight, min(l_orderkey) AS freq_rank FROM lineitem GROUP BY ALL)) WHERE rank <= 5
"""


def vi_headwords(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09, SET-03: parts that lines name and parts of size 10 or less, with counts and flags."""
    links = table(spark, d, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("Párt "), "l_partkey").alias("vi"))
    senses = table(spark, d, "part").where("p_size <= 10").select(F.concat(F.lit("Párt "), "p_partkey").alias("word"))
    return B.vi_headwords(links, senses)


HEADWORDS_SQL = """
WITH a AS (SELECT 'Párt ' || l_partkey AS word, count(*) AS n_links FROM lineitem WHERE l_quantity > 40 GROUP BY 1), b AS (SELECT 'Párt ' || p_partkey AS word, true AS has_wikt FROM part WHERE p_size <= 10)
SELECT word, strip_accents(lower(word)) AS norm, coalesce(n_links, 0) AS n_links, coalesce(has_wikt, false) AS has_wikt FROM a FULL JOIN b USING (word)
"""


def sentence_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-06, VAR-13: conversations' turns as pairs, by word."""
    c = table(spark, d, "conversations")
    ask = c.where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    reply = c.where("role <> 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    links = c.select(F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("vie_id"), F.concat_ws(":", "conv_id", "turn").alias("eng_id"), F.col("turn").alias("place"))
    return B.sentence_pairs(reply, links, ask)


PAIRS_SQL = """
SELECT a.conv_id::VARCHAR || ':' || a.turn::VARCHAR AS eng_id, a.text AS en, min(b.text) AS vi FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role <> 'user' AND length(a.text) <= 120 GROUP BY ALL
"""


def pairs_by_word(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-07, WIN-05: each frequent word's six shortest user turns; a word with an s counts for the one without."""
    c = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("tid"), F.col("text").alias("en")).distinct()
    words = c.select(F.explode(F.array_distinct(T.tokens("en"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5").select("word")
    return B.pairs_by_word(c, words, words.select(F.concat("word", F.lit("s")).alias("form"), F.col("word").alias("lemma")))


BY_WORD_SQL = """
WITH c AS (SELECT DISTINCT conv_id * 1000 + turn AS tid, text AS en FROM conversations WHERE role = 'user'),
t AS (SELECT DISTINCT tid, length(en) AS n, unnest(regexp_extract_all(lower(en), '[a-z][a-z'']*')) AS token FROM c),
w AS (SELECT token AS word FROM t GROUP BY 1 HAVING count(*) >= 5),
f AS (SELECT DISTINCT tid, n, coalesce(a.word, b.word) AS headword FROM t LEFT JOIN w a ON a.word = token LEFT JOIN w b ON b.word || 's' = token)
SELECT headword, tid FROM (SELECT *, row_number() OVER (PARTITION BY headword ORDER BY n, tid) AS k FROM f WHERE headword IS NOT NULL) WHERE k <= 6
"""


def first_not_null(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23, AGG-24: each user's first large value and first click."""
    e = table(spark, d, "events").withColumn("large", F.when(F.col("value") > 50, F.col("value"))).withColumn("click", F.when(F.col("event_type") == "click", F.col("event_id")))
    return R.first_not_null(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], "large", "click")


FIRST_SQL = """
SELECT user_id, first(value ORDER BY ts, event_id) FILTER (value > 50) AS large, first(event_id ORDER BY ts, event_id) FILTER (event_type = 'click') AS click FROM events GROUP BY user_id
"""


def balanced_pick(spark: SparkSession, d: str) -> DataFrame:
    """WIN-03: five parts of each size, at most three of one brand first."""
    return R.balanced_pick(table(spark, d, "part"), ["p_size"], "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 5).select("p_size", "p_partkey", "picked")


BALANCED_SQL = """
SELECT p_size, p_partkey, picked FROM (
  SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY over, p_retailprice DESC, p_partkey) AS picked FROM (
    SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_retailprice DESC, p_partkey) > 3 AS over FROM part)) WHERE picked <= 5
"""


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12, LKP-11."""
    return Q.table_counts({x: table(spark, d, x) for x in ("customer", "orders", "documents", "labels")})


COUNTS_SQL = " UNION ALL ".join(f"SELECT '{x}' AS \"table\", count(*) AS n FROM {x}" for x in ("customer", "orders", "documents", "labels"))


def difference(spark: SparkSession, d: str) -> DataFrame:
    """SET-11: rows that differ between two samples of the labels, with multiplicity."""
    rows = table(spark, d, "labels")
    return R.symmetric_difference(rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 <> 1"))


DIFF_SQL = """
SELECT *, 'left' AS side FROM (SELECT * FROM labels WHERE doc_id % 3 <> 0 EXCEPT ALL SELECT * FROM labels WHERE doc_id % 3 <> 1)
UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM labels WHERE doc_id % 3 <> 1 EXCEPT ALL SELECT * FROM labels WHERE doc_id % 3 <> 0)
"""


def role_coverage(spark: SparkSession, d: str) -> DataFrame:
    """AGG-28: customers with two orders or more in each status."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("lemma"), F.lit("c").alias("pos"), F.col("o_orderstatus").alias("role"))
    return Q.role_coverage(o, o.select("pos", "role").distinct())


ROLE_SQL = """
WITH n AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT DISTINCT o_custkey FROM orders), s AS (SELECT DISTINCT o_orderstatus FROM orders),
p AS (SELECT o_custkey, bool_and(coalesce(n, 0) >= 2) AS full FROM a CROSS JOIN s LEFT JOIN n USING (o_custkey, o_orderstatus) GROUP BY 1)
SELECT 'c' AS pos, count_if("full") AS "full", count(*) AS words FROM p
"""


def vi_terms(spark: SparkSession, d: str) -> DataFrame:
    """STR-17, SET-06: short terms of whole texts, as of glosses."""
    from wordloom.plans.corpus_queries import docs

    return docs(spark, d).select("doc_id", F.array_join(T.vi_terms("text"), "|").alias("terms"))


TERMS_SQL = r"""
WITH p AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[;,/]| hoặc ') AS parts FROM documents),
t AS (SELECT doc_id, list_transform(parts, lambda x: trim(regexp_replace(lower(regexp_replace(x, '[.…!?:"“”''‘’\-–~]+', ' ', 'g')), '[\t\n\v\f\r \x{85}\x{A0}]+', ' ', 'g'))) AS ts FROM p),
f AS (SELECT doc_id, list_filter(ts, lambda x: len(string_split(x, ' ')) <= 4 AND regexp_matches(x, '^[\p{L}\p{M}]+( [\p{L}\p{M}]+)*$')) AS ts FROM t),
u AS (SELECT doc_id, list_filter(ts, lambda x, i: list_position(ts, x) = i) AS ts FROM f)
SELECT doc_id, array_to_string(ts, '|') AS terms FROM u
"""


def batches(spark: SparkSession, d: str) -> DataFrame:
    """BAT-05, BAT-06, MTH-09: orders as words in price order, their lines as senses, packed in two classes."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("cost"))
    o = table(spark, d, "orders").join(n, "o_orderkey")
    words = R.global_rank(o.select(F.concat(F.lit("w"), "o_orderkey").alias("word"), "cost", "o_totalprice", "o_orderkey"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "place").select("place", "word", "cost")
    return P.plan(words, "v1", {"low": "small", "medium": "large"}, {"low": 12, "medium": 6}, {"low": 40, "medium": 70}, hard=6).select("id", "model", F.size("words").alias("n"), "rank_first")


BATCHES_SQL = """
WITH c AS (SELECT l_orderkey AS o_orderkey, count(*) AS cost FROM lineitem GROUP BY 1),
w AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, 'w' || o_orderkey AS word, cost FROM orders JOIN c USING (o_orderkey)),
k AS (SELECT *, cost >= 6 AS hard, row_number() OVER (PARTITION BY cost >= 6 ORDER BY place) AS i FROM w),
u AS (SELECT a.hard, a.i, b.i AS j, sum(b.cost) OVER (PARTITION BY a.hard, a.i ORDER BY b.i) AS total FROM k a JOIN k b ON a.hard = b.hard AND b.i BETWEEN a.i AND a.i + CASE WHEN a.hard THEN 5 ELSE 11 END),
n AS MATERIALIZED (SELECT hard, i, max(j) + 1 AS nx FROM u WHERE j = i OR total <= CASE WHEN hard THEN 70 ELSE 40 END GROUP BY ALL),
s AS (WITH RECURSIVE r(hard, i) AS (SELECT hard, i FROM n WHERE i = 1 UNION ALL SELECT n.hard, n.nx FROM r JOIN n ON n.hard = r.hard AND n.i = r.i) SELECT hard, i, lead(i) OVER (PARTITION BY hard ORDER BY i) AS nx FROM r),
b AS (SELECT s.hard, s.i, list(k.word ORDER BY k.place) AS ws, min(k.place) AS rank_first FROM s JOIN k ON k.hard = s.hard AND k.i >= s.i AND k.i < coalesce(s.nx, s.i) GROUP BY ALL)
SELECT substr(sha1('v1|' || CASE WHEN hard THEN 'large' ELSE 'small' END || '|' || array_to_string(ws, '|')), 1, 14) AS id, CASE WHEN hard THEN 'large' ELSE 'small' END AS model, len(ws)::INT AS n, rank_first FROM b
"""


def lists_and_items(spark: SparkSession, d: str) -> DataFrame:
    """USR-08, NST-15: half of the events' items are there; the other half are added."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("list_id"), F.col("event_type").alias("word"), F.lit("").alias("pos"), (F.col("event_id") % 7).cast("string").alias("sense"), F.lit("x").alias("label"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("added_at"))
    old = S.add_items(e.limit(0), e.where("id % 2 = 0"))
    return S.saved_keys(S.add_items(old, e.where("id % 2 = 1"))).distinct()


ITEMS_SQL = "SELECT DISTINCT user_id AS list_id, concat_ws('|', event_type, '', (event_id % 7)::VARCHAR) AS key FROM events"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """An extension: sessions of a user's events."""
    from wordloom.streaming.history import sessions as s

    out = s(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return out.select("user_id", F.date_format("begins", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("begins"), "n")


SESSION_SQL = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS begins, count(*) AS n FROM s GROUP BY user_id, k
"""

QUERIES = {
    "coverage_metrics": (coverage_metrics, COVERAGE_SQL),
    "gate": (gate, GATE_SQL),
    "topk_per_group": (topk_per_group, "SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3"),
    "budget_cut": (budget_cut, BUDGET_SQL),
    "neighbours": (neighbours, NEIGHBOURS_SQL),
    "latest_wins": (latest_wins, "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"),
    "history_upsert": (history_upsert, HISTORY_SQL),
    "history_stream": (history_stream, STREAM_SQL),
    "left_join_count": (left_join_count, "SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"),
    "anti_semi": (anti_semi, "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= '1996-01-01') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < '1996-01-01')"),
    "run_grouping": (run_grouping, RUN_SQL),
    "nested_assembly": (nested_assembly, NESTED_SQL),
    "csv_rows": (csv_rows, CSV_SQL),
    "json_validate": (json_validate, JSON_SQL),
    "percentile_sizes": (percentile_sizes, SIZES_SQL),
    "source_stats": (source_stats, STATS_SQL),
    "distinct_words": (distinct_words, DISTINCT_SQL),
    "coverage_cuts": (coverage_cuts, CUTS_SQL),
    "jaccard_match": (jaccard_match, JACCARD_SQL),
    "relation_lift": (relation_lift, LIFT_SQL),
    "prep_patterns": (prep_patterns, PREP_SQL),
    "hypernym_hop": (hypernym_hop, HOP_SQL),
    "grouped_links": (grouped_links, LINKS_SQL),
    "vi_headwords": (vi_headwords, HEADWORDS_SQL),
    "sentence_pairs": (sentence_pairs, PAIRS_SQL),
    "pairs_by_word": (pairs_by_word, BY_WORD_SQL),
    "first_not_null": (first_not_null, FIRST_SQL),
    "balanced_pick": (balanced_pick, BALANCED_SQL),
    "table_counts": (table_counts, COUNTS_SQL),
    "symmetric_difference": (difference, DIFF_SQL),
    "role_coverage": (role_coverage, ROLE_SQL),
    "vi_terms": (vi_terms, TERMS_SQL),
    "batch_plan": (batches, BATCHES_SQL),
    "lists_and_items": (lists_and_items, ITEMS_SQL),
    "sessions": (sessions, SESSION_SQL),
}
