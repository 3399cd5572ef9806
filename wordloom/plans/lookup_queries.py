"""Queries of lookups and entry views, over the vocabulary of all documents or over orders as a lexicon's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import lookup as L
from wordloom.operators import nested as N
from wordloom.operators import reports as P
from wordloom.operators.service import Service
from wordloom.plans.corpus_queries import WITH, docs, kept, table, vocabulary


def typed(spark: SparkSession, d: str, lower: bool = False) -> DataFrame:
    """Every word of the documents and how often it is there, as typed or in lower case: word, n.

    A kept table: texts are split once, and Spark can't move what is asked of a word below the count, where it would be worked out for each place of the word.
    """
    text = F.lower("text") if lower else F.col("text")
    words = lambda: docs(spark, d).select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("word <> ''")
    return kept(spark, d, "lower words" if lower else "typed words", words)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the documents as typed, with a mode; the shortest also with a leading key and a sign."""
    w = typed(spark, d).select(F.col("word").alias("w"))
    mode = F.when(F.length("w") % 5 == 0, "vien").otherwise("envi")
    return w.select("w", mode.alias("mode")).select(F.when(F.length("w") == 2, F.concat(F.lit("vi:"), "w")).when(F.length("w") == 3, F.concat(F.lit(" "), "w", F.lit("!"))).otherwise(F.col("w")).alias("raw"), "mode").distinct()


ASKED = r"""
, asked AS (
  SELECT DISTINCT CASE length(w) WHEN 2 THEN 'vi:' || w WHEN 3 THEN ' ' || w || '!' ELSE w END AS raw, CASE WHEN length(w) % 5 = 0 THEN 'vien' ELSE 'envi' END AS mode
  FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS w FROM documents) WHERE w <> '')
"""


def vietnamese(spark: SparkSession, d: str) -> DataFrame:
    """Words with marks as Vietnamese headwords: word, norm, n_links, has_wikt."""
    w = typed(spark, d, lower=True).where(T.looks_vietnamese("word") | (F.length("word") == 4))
    return w.select("word", T.fold("word").alias("norm"), (F.col("n") % 50).alias("n_links"), (F.length("word") % 2 == 0).alias("has_wikt"))


VI = r"""
, vn AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents) GROUP BY 1),
vi AS (SELECT word, strip_accents(replace(word, 'đ', 'd')) AS norm, n % 50 + CASE WHEN length(word) % 2 = 0 THEN 3 ELSE 0 END AS weight FROM vn WHERE strip_accents(word) <> word OR contains(word, 'đ') OR length(word) = 4)
"""
INDEX = """
, ix AS (SELECT a.word AS form, b.word AS headword FROM ranks a JOIN ranks b ON a.word = b.word || 's'),
hw AS (SELECT word, freq_rank FROM ranks WHERE word NOT IN (SELECT form FROM ix))
"""


def index_and_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Forms that end in s beside the words they come from, and the vocabulary without them."""
    v = vocabulary(spark, d)
    index = v.where(F.col("word").endswith("s")).join(v.select(F.concat("word", F.lit("s")).alias("word"), F.col("word").alias("headword")), "word").select(F.col("norm").alias("form_norm"), "headword")
    return index, v.join(index.select(F.col("form_norm").alias("word")).distinct(), "word", "left_anti")


def suggest(spark: SparkSession, d: str) -> DataFrame:
    """LKP-01, SRT-02..04: suggestions for the first three letters of all words, in both modes."""
    index, hw = index_and_words(spark, d)
    qs = typed(spark, d).where("length(word) >= 3").select(F.substring("word", 1, 3).alias("raw")).distinct()
    both = qs.withColumn("mode", F.explode(F.array(F.lit("envi"), F.lit("vien"))))
    return L.suggest(both, hw, vietnamese(spark, d), index)


SUGGEST_SQL = WITH + INDEX + VI + r"""
, a AS (SELECT DISTINCT substr(w, 1, 3) AS raw FROM (SELECT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS w FROM documents) WHERE length(w) >= 3),
b AS (SELECT raw, unnest(['envi', 'vien']) AS mode, strip_accents(replace(lower(raw), 'đ', 'd')) AS q, strip_accents(raw) <> raw OR contains(lower(raw), 'đ') AS marked FROM a),
q AS (SELECT DISTINCT q FROM b),
v0 AS (SELECT q, hw.word, row_number() OVER (PARTITION BY q ORDER BY hw.freq_rank, hw.word) AS k FROM q JOIN ix ON form = q JOIN hw ON hw.word = ix.headword),
e0 AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY freq_rank, length(word), word) AS k FROM q JOIN hw ON starts_with(word, q)),
e1 AS (SELECT q, word, 0 AS lane, k FROM v0 WHERE k <= 3 AND word <> q UNION ALL SELECT q, word, 1, k FROM e0 WHERE k <= 10),
e2 AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY lane, k) AS place, 'en' AS lang FROM e1),
w0 AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY (norm = q) DESC, weight DESC, length(word), norm, word) AS place FROM q JOIN vi ON starts_with(norm, q)),
u AS (SELECT * FROM e2 UNION ALL SELECT q, word, place, 'vi' FROM w0 WHERE place <= 8),
r AS (SELECT raw, mode, u.*, mode = 'vien' OR marked AS first FROM b JOIN u USING (q)),
s AS (SELECT raw, mode, CASE WHEN lang = 'vi' THEN 'vi:' || word ELSE word END AS key, row_number() OVER (PARTITION BY raw, mode ORDER BY CASE WHEN first = (lang = 'vi') THEN 0 ELSE 1 END, place) AS place FROM r WHERE first OR lang = 'vi' OR place <= 7)
SELECT * FROM s WHERE place <= 10
"""


def lookup(spark: SparkSession, d: str) -> DataFrame:
    """LKP-02, LKP-04, LKP-10, LKP-12, SRT-07, T16, FLT-29: every typed word through the service's lookup."""
    index, hw = index_and_words(spark, d)
    s = Service({"headword": hw, "lookup_index": index, "vi_headword": vietnamese(spark, d)})
    out = s.call("lookup", queries=asked(spark, d))
    return out.select("raw", "mode", "kind", F.array_join("words", ",").alias("words"), "also")


LOOKUP_SQL = WITH + INDEX + ASKED + VI + r"""
, a AS (SELECT raw, mode, starts_with(raw, 'vi:') AS forced, trim(regexp_replace(regexp_replace(raw, '^vi:', ''), '!', ' ', 'g')) AS q FROM asked),
b AS (SELECT *, strip_accents(q) <> q OR contains(lower(q), 'đ') AS marked, lower(q) AS l, strip_accents(replace(lower(q), 'đ', 'd')) AS f FROM a),
n AS (SELECT DISTINCT q, l, f, marked FROM b),
vs AS (SELECT q, marked, list(word ORDER BY k) FILTER (k <= 16) AS words FROM (SELECT q, marked, word, row_number() OVER (PARTITION BY q ORDER BY weight DESC, word) AS k FROM n JOIN vi ON norm = f) GROUP BY ALL),
vx AS (SELECT q, word FROM n JOIN vi ON word = l),
vr AS (SELECT coalesce(vs.q, vx.q) AS q, CASE WHEN NOT coalesce(marked, true) AND len(words) > 1 THEN words WHEN vx.word IS NOT NULL THEN [vx.word] ELSE words END AS vw FROM vs FULL JOIN vx ON vs.q = vx.q),
c AS (
  SELECT q, 1 AS step, word, freq_rank FROM n JOIN hw ON word = q UNION ALL SELECT q, 2, word, freq_rank FROM n JOIN hw ON word = l
  UNION ALL SELECT q, 3, hw.word, hw.freq_rank FROM n JOIN ix ON form = f JOIN hw ON hw.word = ix.headword UNION ALL SELECT q, 4, word, freq_rank FROM n JOIN hw ON word = f),
r AS (SELECT *, row_number() OVER (PARTITION BY q, step ORDER BY freq_rank, word) AS place, min(step) OVER (PARTITION BY q) AS least FROM c),
er AS (SELECT q, list(word ORDER BY place) AS ew FROM r WHERE step = least AND (place = 1 OR (step = 4 AND place <= 6)) GROUP BY q),
m AS (SELECT b.*, vw, CASE WHEN NOT forced AND NOT marked THEN ew END AS ew, forced OR mode = 'vien' OR marked AS want FROM b LEFT JOIN vr ON vr.q = b.q LEFT JOIN er ON er.q = b.q),
o AS (SELECT *, vw IS NOT NULL AND (want OR ew IS NULL) AS take, CASE WHEN vw IS NOT NULL AND (want OR ew IS NULL) THEN vw ELSE ew END AS words FROM m),
k AS (SELECT *, CASE WHEN q = '' THEN 'empty' WHEN words IS NULL THEN 'none' WHEN len(words) > 1 THEN 'choice' WHEN take THEN 'vi' ELSE 'en' END AS kind FROM o)
SELECT raw, mode, kind, CASE WHEN q <> '' THEN array_to_string(words, ',') END AS words,
  CASE kind WHEN 'vi' THEN CASE WHEN want AND len(ew) = 1 THEN ew[1] END WHEN 'en' THEN CASE WHEN len(vw) = 1 THEN vw[1] WHEN len(vw) > 1 THEN q END END AS also FROM k
"""


def exists(spark: SparkSession, d: str) -> DataFrame:
    """LKP-09, LKP-14, JOIN-20, VAR-31, VAR-29: which words of conversations are in the vocabulary, with their search forms."""
    qs = table(spark, d, "conversations").select(F.explode(T.tokens("text")).alias("q")).distinct()
    v = vocabulary(spark, d)
    out = Service({"headword": v}).call("exists", queries=qs)
    return out.join(P.word_list(v).select(F.col("word").alias("q"), "low", "bare", "size"), "q", "left")


EXISTS_SQL = WITH + """
, q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z'']*')) AS q FROM conversations)
SELECT q, word IS NOT NULL AS exists, lower(word) AS low, lower(word) AS bare, CASE WHEN word IS NOT NULL THEN greatest(0, length(word) - 2)::INT END AS size FROM q LEFT JOIN ranks ON word = q
"""


def lexicon(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as entries of their customers, lines as senses, parts of lines as examples, forms and sounds."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    lines = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = li.withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    entry = o.selectExpr("o_orderkey AS id", "o_custkey AS headword", "o_orderpriority AS pos", "cast(o_orderkey AS int) AS ord", "o_orderstatus AS entry_type", "CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS freq_rank", "'A1' AS cefr", "'e' AS etymology", "CASE WHEN o_orderkey % 3 = 0 THEN 'm' END AS ai_model")
    sense = li.select("id", F.col("l_orderkey").alias("entry_id"), F.when(F.col("l_returnflag") == "R", "learner").otherwise("full").alias("layer"), lines.alias("ord"), F.col("l_linestatus").alias("guideword"), F.lit("").alias("grammar"), F.lit("").alias("labels"), F.concat(F.lit("d<"), "l_partkey").alias("definition"), F.lit(None).cast("string").alias("vi"))
    example = li.where("l_quantity > 25").select(F.col("id").alias("sense_id"), lines.alias("ord"), F.concat(F.lit("x"), "l_suppkey").alias("text_en"), F.lit("y").alias("text_vi"))
    form = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS entry_id", "explode(sequence(0, cast(o_orderkey % 3 AS int))) AS ord").selectExpr("entry_id", "ord", "'f' || ord AS form", "array('t') AS tags")
    sounds = o.selectExpr("o_orderkey AS entry_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'uk' ELSE 'us' END AS accent", "'/' || o_orderkey || '/' AS ipa")
    return {"headword": table(spark, d, "customer").selectExpr("c_custkey AS word", "c_name AS norm", "c_custkey AS freq_rank"), "entry": entry, "sense": sense, "example": example, "form": form, "pronunciation": sounds}


def entries(spark: SparkSession, d: str) -> DataFrame:
    """LKP-06, LKP-15, NST-11, AGG-25, SRT-06, JOIN-13, SNK-26, SNK-27, VAR-41, VAR-42: each customer's entry view, flat, and its text."""
    s = Service(lexicon(spark, d))
    view = s.call("get_entry", words=table(spark, d, "customer").selectExpr("c_custkey AS word"))
    block = lambda b: F.concat_ws("|", b["pos"], b["entry_type"], F.coalesce(F.array_join(F.transform(b["forms"], lambda f: f["form"]), "+"), F.lit("-")), F.coalesce(F.array_join(F.transform(b["senses"], lambda s: F.concat_ws("/", s["layer"], s["definition"], F.array_join(F.transform(s["examples"], lambda e: e["text_en"]), "+"))), ","), F.lit("-")))
    text = P.entry_text(view)
    return view.join(text, "word").select("word", "freq_rank", "ipa.uk", "ipa.us", F.md5(F.array_join(F.transform("blocks", block), ";")).alias("blocks"), F.length("text").alias("letters"), F.md5("html").alias("html"))


ENTRY_SQL = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
f AS (SELECT o_orderkey, string_agg('f' || j, '+' ORDER BY j) AS forms FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 3 + 1)) AS j FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1),
s AS (
  SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN 'learner' ELSE 'full' END || '/d<' || l_partkey || '/' || CASE WHEN l_quantity > 25 THEN 'x' || l_suppkey ELSE '' END, ',' ORDER BY k) AS senses,
    list('d<' || l_partkey ORDER BY k) FILTER (l_returnflag = 'R') AS learner, list('d<' || l_partkey ORDER BY k) AS every FROM l GROUP BY 1),
b AS (
  SELECT o_custkey, o_orderkey, o_orderkey % 3 <> 0 AS plain, o_orderpriority AS pos, o_orderpriority || '|' || o_orderstatus || '|' || coalesce(forms, '-') || '|' || coalesce(senses, '-') AS block, coalesce(learner, every[:12], []) AS shown
  FROM orders o LEFT JOIN f USING (o_orderkey) LEFT JOIN s ON l_orderkey = o_orderkey),
n AS (SELECT *, CASE WHEN len(shown) > 1 THEN list_transform(shown, lambda x, i: i || '. ' || x) ELSE shown END AS num FROM b),
t AS (
  SELECT o_custkey AS word, md5(string_agg(block, ';' ORDER BY plain, o_orderkey)) AS blocks,
    o_custkey || chr(10) || string_agg(pos || CASE WHEN len(num) > 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN chr(10) || array_to_string(num, chr(10)) ELSE '' END, chr(10) ORDER BY plain, o_orderkey) AS text,
    '<b>' || o_custkey || '</b>' || string_agg('<p><i>' || pos || '</i></p>' || array_to_string(list_transform(num, lambda x: '<p>' || replace(x, '<', '&lt;') || '</p>'), ''), '' ORDER BY plain, o_orderkey) AS html FROM n GROUP BY o_custkey),
a AS (SELECT o_custkey AS word, arg_min(o_orderkey, (o_orderkey % 3 <> 0, o_orderkey)) FILTER (o_orderstatus = 'O') AS freq_rank, arg_min('/' || o_orderkey || '/', (o_orderkey % 3 <> 0, o_orderkey)) FILTER (o_orderkey % 2 = 0) AS uk,
  arg_min('/' || o_orderkey || '/', (o_orderkey % 3 <> 0, o_orderkey)) FILTER (o_orderkey % 2 = 1) AS us FROM orders GROUP BY 1)
SELECT word, freq_rank, uk, us, blocks, length(text)::INT AS letters, md5(html) AS html FROM t JOIN a USING (word)
"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    """LKP-08, NST-13, SRT-14: each customer's usage view: prepositions, collocations, examples and twelve sequences."""
    o = table(spark, d, "orders")
    by = lambda *c: o.groupBy(F.col("o_custkey").alias("headword"), *c)
    prep = by(F.lit("v").alias("pos"), F.col("o_orderpriority").alias("prep")).agg(F.lit("sth").alias("obj"), F.count("*").alias("n"), F.lit(0.5).alias("ratio"), F.lit(True).alias("common"))
    coll = o.selectExpr("o_custkey AS headword", "'v' AS pos", "o_orderstatus AS pattern", "o_orderpriority AS display", "1L AS n", "cast(o_orderkey AS int) AS rank")
    ex = o.where("o_orderkey % 2 = 0").selectExpr("o_custkey AS headword", "'v' AS pos", "'role' AS kind", "'k' AS key", "cast(o_orderkey AS string) AS text", "'s' AS source", "0 AS hl_start", "1 AS hl_end", "5 AS n_words", "o_totalprice AS score")
    seq = o.selectExpr("o_custkey AS headword", "o_orderstatus AS pos", "cast(o_orderkey AS string) AS seq", "o_orderkey % 7 AS n")
    s = Service({"headword": o, "usage_prep": prep, "usage_coll": coll, "usage_example": ex, "usage_prep_seq": seq})
    view = s.call("get_usage", words=o.selectExpr("o_custkey AS word").distinct())
    join = lambda c, f: F.md5(F.array_join(F.transform(c, f), ","))
    return view.select("word", join("preps", lambda x: F.concat_ws(":", x["prep"], x["n"])).alias("preps"), join("colls", lambda x: F.concat_ws(":", x["pattern"], x["display"])).alias("colls"), join("examples", lambda x: x["text"]).alias("examples"), join("seqs", lambda x: F.concat_ws(":", x["seq"], x["n"])).alias("seqs"))


USAGE_SQL = """
WITH p AS (SELECT o_custkey AS word, o_orderpriority AS prep, count(*) AS n FROM orders GROUP BY ALL), pa AS (SELECT word, md5(string_agg(prep || ':' || n, ',' ORDER BY n DESC, prep)) AS preps FROM p GROUP BY 1),
c AS (SELECT o_custkey AS word, md5(string_agg(o_orderstatus || ':' || o_orderpriority, ',' ORDER BY o_orderstatus, o_orderkey)) AS colls FROM orders GROUP BY 1),
e AS (SELECT o_custkey AS word, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey::VARCHAR)) AS examples FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
q AS (SELECT o_custkey AS word, o_orderkey::VARCHAR AS seq, o_orderkey % 7 AS n, o_orderstatus AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7 DESC, o_orderstatus, o_orderkey::VARCHAR) AS k FROM orders),
s AS (SELECT word, md5(string_agg(seq || ':' || n, ',' ORDER BY k)) AS seqs FROM q WHERE k <= 12 GROUP BY 1)
SELECT * FROM pa JOIN c USING (word) LEFT JOIN e USING (word) JOIN s USING (word)
"""


def vietnamese_entries(spark: SparkSession, d: str) -> DataFrame:
    """LKP-07, NST-12, JOIN-12, JOIN-14, T18: suppliers' views of parts as links, runs of flags, sentence pairs, and the words they mention."""
    from wordloom.operators import bilingual as B

    li = table(spark, d, "lineitem")
    links = B.grouped_links(li.selectExpr("l_suppkey AS vi", "l_partkey AS headword", "l_returnflag AS pos", "cast(NULL AS string) AS guideword", "l_linestatus AS definition", "'s' AS source", "cast(l_quantity AS int) AS weight", "l_orderkey AS freq_rank"), 5)
    runs = B.sense_runs(table(spark, d, "supplier").selectExpr("s_suppkey AS word", "explode(sequence(0, cast(s_suppkey % 4 AS int))) AS ord").selectExpr("word", "0 AS place", "ord", "CASE WHEN ord < 2 THEN 'n' ELSE 'v' END AS pos", "'g' || ord AS gloss"))
    pairs = P.pair_texts(li.where("l_quantity > 45").selectExpr("l_suppkey AS headword", "l_orderkey AS tid").distinct(), table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS en", "o_orderpriority AS vi")).withColumnRenamed("headword", "phrase")
    view = P.vi_views(links, runs, pairs)
    known = N.known_words(links.selectExpr("vi AS word", "headword AS ref"), table(spark, d, "part").where("p_size < 25").selectExpr("p_partkey AS word"))
    return view.join(known, "word", "left").select(
        "word", F.array_join(F.transform("en", lambda x: F.concat_ws(":", x["headword"], x["pos"])), ",").alias("en"), F.array_join(F.transform("wikt", lambda x: F.concat_ws(":", x["pos"], F.array_join(x["glosses"], "+"))), ",").alias("wikt"),
        F.md5(F.array_join(F.transform("pairs", lambda x: F.concat(x["en"], x["vi"])), ",")).alias("pairs"), F.array_join(F.col("known").cast("array<string>"), ",").alias("known"),
    )


VI_ENTRY_SQL = """
WITH g AS (SELECT l_suppkey AS word, l_partkey AS hw, l_returnflag AS pos, max(l_quantity)::INT AS w, min(l_orderkey) AS f FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY w DESC, f, hw, pos) AS k FROM g),
a AS (SELECT word, string_agg(hw || ':' || pos, ',' ORDER BY k) AS en, array_to_string(list_sort(list_distinct(list(hw) FILTER (hw IN (SELECT p_partkey FROM part WHERE p_size < 25)))), ',') AS known FROM k WHERE k <= 5 GROUP BY 1),
b AS (SELECT s_suppkey AS word, ['n:g0', 'n:g0+g1', 'n:g0+g1,v:g2', 'n:g0+g1,v:g2+g3'][s_suppkey % 4 + 1] AS wikt FROM supplier),
t AS (SELECT DISTINCT l_suppkey AS word, l_orderkey FROM lineitem WHERE l_quantity > 45),
p AS (SELECT word, md5(string_agg(o_orderstatus || o_orderpriority, ',' ORDER BY o_orderkey)) AS pairs FROM t JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT word, en, wikt, pairs, CASE WHEN known = '' THEN NULL ELSE known END AS known FROM a FULL JOIN b USING (word) LEFT JOIN p USING (word)
"""

QUERIES = {
    "suggest": (suggest, SUGGEST_SQL),
    "lookup": (lookup, LOOKUP_SQL),
    "exists": (exists, EXISTS_SQL),
    "entry_views": (entries, ENTRY_SQL),
    "usage_views": (usage, USAGE_SQL),
    "vietnamese_entries": (vietnamese_entries, VI_ENTRY_SQL),
}
