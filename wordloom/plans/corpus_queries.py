"""Queries over sentences and words of ``documents``, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import corpus as C
from wordloom.operators import lookup as L
from wordloom.operators.relational import bottom_k_sample, round_robin, top_k
from wordloom.operators.tables import cut


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def sentence_dedup(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_sentences(docs(spark, d))


SENTENCES = r"""
pieces AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z"“])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s,
         generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+([A-Z"“])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) - 1 AS place
  FROM documents),
trimmed AS (SELECT doc_id, place, trim(s) AS sentence FROM pieces),
plausible AS (
  SELECT * FROM trimmed WHERE length(sentence) BETWEEN 20 AND 300
    AND length(sentence) - length(replace(sentence, ' ', '')) + 1 BETWEEN 5 AND 40
    AND regexp_matches(substr(sentence, 1, 1), '^\p{Lu}') AND right(sentence, 1) IN ('.', '!', '?', '"', '”')),
clean AS (
  SELECT doc_id, place, sentence FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(sentence) ORDER BY doc_id, place) AS n FROM plausible) WHERE n = 1),
words AS (SELECT unnest(regexp_extract_all(lower(sentence), '[a-z][a-z'']*')) AS word FROM clean),
counts AS (SELECT word, count(*) AS n FROM words GROUP BY word),
ranks AS (
  SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS freq_rank FROM counts)
"""
WITH = "WITH " + SENTENCES


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def stamp(spark: SparkSession, path: str) -> str:
    """A table's files with their sizes and times: another one after any change."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return ",".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in [fs.getFileStatus(at), *fs.listStatus(at)]))


def kept(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table, of words or of clean sentences, that a session's queries share, built once from ``documents`` as they are and kept in the shared folder."""
    key = spark.sparkContext.applicationId, f"{d}|{stamp(spark, f'{d}/documents.parquet')}", name
    if key not in _KEPT:
        _KEPT[key] = cut(build())
    return _KEPT[key]


def ranks(spark: SparkSession, d: str, sentences: DataFrame | None = None) -> DataFrame:
    """Words by rank, counted in the clean sentences; a query that has kept these gives them."""
    return kept(spark, d, "ranks", lambda: C.frequency_ranks(C.word_counts(C.clean_sentences(docs(spark, d)) if sentences is None else sentences)))


def grams(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "grams", lambda: L.gram_index(vocabulary(spark, d)))


RANKS_SQL = WITH + """
SELECT word, n, freq_rank, CASE WHEN freq_rank <= 3000 THEN 'Top 3000' WHEN freq_rank <= 5000 THEN 'Top 5000' END AS freq_band FROM ranks
"""


def band_sample(spark: SparkSession, d: str) -> DataFrame:
    """SRT-10, SRT-11: 20 words of each band."""
    rows = ranks(spark, d).withColumn("freq_band", F.coalesce("freq_band", F.lit("rest")))
    return bottom_k_sample(rows, ["freq_band"], T.uniform("word"), [F.asc("word")], 20).select("freq_band", "word")


UNIFORM = "('0x' || substr(sha256('0' || chr(31) || {}), 1, 13))::BIGINT"
BAND_SAMPLE_SQL = WITH + f"""
, banded AS (SELECT word, CASE WHEN freq_rank <= 3000 THEN 'Top 3000' WHEN freq_rank <= 5000 THEN 'Top 5000' ELSE 'rest' END AS freq_band FROM ranks)
SELECT freq_band, word FROM (SELECT *, row_number() OVER (PARTITION BY freq_band ORDER BY {UNIFORM.format('word')}, word) AS n FROM banded) WHERE n <= 20
"""


def one_each(spark: SparkSession, d: str) -> DataFrame:
    """SRT-12: one sentence of each document by a value-based draw."""
    return bottom_k_sample(C.clean_sentences(docs(spark, d)), ["doc_id"], T.uniform("sentence"), [F.asc("sentence")], 1).select("doc_id", "sentence")


ONE_EACH_SQL = WITH + f"""
SELECT doc_id, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {UNIFORM.format('sentence')}, sentence) AS n FROM clean) WHERE n = 1
"""


def logdice(spark: SparkSession, d: str) -> DataFrame:
    s = C.clean_sentences(docs(spark, d))
    return C.associations(C.adjacent_pairs(s), ranks(spark, d).select("word", "n")).select("left", "right", "n", F.round("logdice", 6).alias("logdice"))


PAIRS = """
, lists AS (SELECT regexp_extract_all(lower(sentence), '[a-z][a-z'']*') AS w FROM clean),
pairs AS (
  SELECT w[i] AS "left", w[i + 1] AS "right", count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM lists WHERE len(w) > 1) GROUP BY ALL),
scored AS (
  SELECT p."left", p."right", p.n, 14 + log2(2 * p.n / (x.n + y.n)) AS logdice
  FROM pairs p JOIN counts x ON x.word = p."left" JOIN counts y ON y.word = p."right" WHERE p.n >= 5)
"""
LOGDICE_SQL = WITH + PAIRS + """SELECT "left", "right", n, round(logdice, 6) AS logdice FROM scored WHERE logdice >= 3.0"""


def ranked_collocations(spark: SparkSession, d: str) -> DataFrame:
    rows = logdice(spark, d).select(F.col("left").alias("lemma"), F.lit("W").alias("pos"), F.lit("W + W").alias("pattern"), F.col("right").alias("display"), F.col("right").alias("colloc"), "n", "logdice")
    return C.ranked_collocations(rows, C.COLL_SHOWN).select("lemma", "display", "n", "logdice", "rank")


RANKED_SQL = WITH + PAIRS + """
SELECT lemma, display, n, logdice, rank FROM (
  SELECT "left" AS lemma, "right" AS display, n, round(logdice, 6) AS logdice, row_number() OVER (PARTITION BY "left" ORDER BY round(logdice, 6) DESC, n DESC, "right") AS rank
  FROM scored WHERE logdice >= 3.0) WHERE rank <= 12
"""


def _words() -> Column:
    """A sentence's words, in lower case, and how many but the first are capitalised, which stand for proper nouns here."""
    return F.filter(F.split(F.lower("sentence"), r"[^\p{L}']+"), lambda w: w != "")


def _names() -> Column:
    return F.size(F.filter(F.slice(F.filter(F.split("sentence", r"[^\p{L}']+"), lambda w: w != ""), 2, 1000), lambda w: w.rlike(r"^\p{Lu}")))


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03..06, AGG-18: how many sentences of each document source each reason rejects."""
    s = C.article_sentences(docs(spark, d), "text", "source")
    reason = F.coalesce(C.reject_reason(F.col("sentence"), _words(), _names()), F.lit("good"))
    return s.select("source", reason.alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("n"))


REASON = r"""
CASE WHEN NOT len(w) BETWEEN 5 AND 35 THEN 'length'
  WHEN NOT (regexp_matches(substr(sentence, 1, 1), '^\p{Lu}') AND right(sentence, 1) IN ('.', '!', '?')) THEN 'not whole'
  WHEN regexp_matches(sentence, '[()\[\]{}|=<>@#/\\_*~^]|https?:|www\.') OR (length(sentence) - length(replace(sentence, '"', ''))) % 2 <> 0 THEN 'characters'
  WHEN regexp_matches(sentence, '\S+@\S+|\+?\d[\d\s().-]{7,}\d') OR length(regexp_replace(sentence, '[^0-9]', '', 'g')) > 4 THEN 'personal'
  WHEN list_has_any(w, [BLOCKED]) THEN 'blocked' WHEN names / len(w) > 0.3 THEN 'names' END
""".replace("BLOCKED", ", ".join(f"'{w}'" for w in C.BLOCKED))
NAMES = r"len(list_filter(list_filter(regexp_split_to_array(sentence, '[^\p{L}'']+'), lambda x: x <> '')[2:], lambda x: regexp_matches(x, '^\p{Lu}')))"
WORD_LIST = r"list_filter(regexp_split_to_array(lower(sentence), '[^\p{L}'']+'), lambda x: x <> '')"
REJECT_SQL = WITH + rf"""
, s AS (SELECT d.source, t.sentence, {WORD_LIST} AS w, {NAMES} AS names FROM trimmed t JOIN documents d USING (doc_id) WHERE length(t.sentence) BETWEEN 20 AND 300)
SELECT source, coalesce({REASON}, 'good') AS reason, count(*) AS n FROM s GROUP BY ALL
"""


def good_examples(spark: SparkSession, d: str) -> DataFrame:
    """FLT-03, MTH-02, WIN-02, WIN-03: for each language five good sentences, balanced over sources."""
    s = C.clean_sentences(docs(spark, d)).join(docs(spark, d).select("doc_id", "lang", F.col("source").alias("family")), "doc_id")
    s = s.withColumn("w", _words()).withColumn("names", _names()).where(C.reject_reason(F.col("sentence"), F.col("w"), F.col("names")).isNull())
    common = F.size(F.filter("w", lambda x: F.length(x) <= 4)) / F.size("w")
    s = s.withColumn("score", F.round(C.sentence_score(F.col("w"), common, F.col("names"), C.soft_words(F.col("w"))), 6))
    return C.good_examples(s.select("lang", "family", "sentence", "score"), 5, ["lang"]).select("lang", "family", "sentence", "score", "picked")


SOFT = ", ".join(f"'{w}'" for w in C.SOFT)
OPENERS = ", ".join(f"'{w}'" for w in C.OPENING_PRONOUNS)
SCORED = rf"""
, s AS (SELECT d.lang, d.source AS family, c.sentence, {WORD_LIST} AS w, {NAMES} AS names FROM clean c JOIN documents d USING (doc_id)),
good AS (
  SELECT lang, family, sentence, round(2.0 * len(list_filter(w, lambda x: length(x) <= 4)) / len(w) - 0.4 * names - len(list_filter(w, lambda x: x IN ({SOFT})))
    + CASE WHEN len(w) BETWEEN 8 AND 20 THEN 1.0 ELSE 0.0 END - CASE WHEN w[1] IN ({OPENERS}) THEN 0.6 ELSE 0.0 END, 6) AS score
  FROM s WHERE {REASON} IS NULL)
"""
EXAMPLES_SQL = WITH + SCORED + """
, inside AS (SELECT *, row_number() OVER (PARTITION BY lang, family ORDER BY score DESC, sentence) > 3 AS over FROM good)
SELECT lang, family, sentence, score, picked FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY over, score DESC, sentence) AS picked FROM inside) WHERE picked <= 5
"""


def text_flags(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04, FLT-05, FLT-15, FLT-19, T8: predicates of each clean sentence."""
    s = C.clean_sentences(docs(spark, d))
    hit = F.locate(" ", F.col("sentence"))
    return s.select(
        "doc_id", "place", T.has_odd_characters("sentence").alias("odd"), T.has_personal_data("sentence").alias("personal"), T.spaced_words("sentence").alias("n_words"),
        T.length_bucket(T.spaced_words("sentence")).alias("bucket"), T.usable_highlight(F.col("sentence"), hit, hit + 3).alias("usable"),
    )


FLAGS_SQL = WITH + r"""
, f AS (
  SELECT *, instr(sentence, ' ') AS hit, length(sentence) - length(replace(sentence, ' ', '')) + 1 AS n_words,
    list_filter(string_split_regex(sentence, '\s+'), lambda x: regexp_matches(x, '^\p{L}')) AS w FROM clean)
SELECT doc_id, place, regexp_matches(sentence, '[()\[\]{}|=<>@#/\\_*~^]|https?:|www\.') OR (length(sentence) - length(replace(sentence, '"', ''))) % 2 <> 0 AS odd,
  regexp_matches(sentence, '\S+@\S+|\+?\d[\d\s().-]{7,}\d') OR length(regexp_replace(sentence, '[^0-9]', '', 'g')) > 4 AS personal, n_words,
  CASE WHEN n_words <= 12 THEN 'short' WHEN n_words <= 20 THEN 'mid' ELSE 'long' END AS bucket,
  NOT (hit > 0 AND regexp_matches(substr(sentence, hit + 1, 1), '^\p{Lu}')) AND substr(sentence, hit, 1) <> '-' AND substr(sentence, hit + 4, 1) <> '-'
    AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}'))) <= 0.4 * len(w) AS usable
FROM f
"""


def highlights(spark: SparkSession, d: str) -> DataFrame:
    """STR-24, STR-25, STR-29, VAR-48: ways to show the second word of a sentence."""
    s = C.clean_sentences(docs(spark, d)).withColumn("a", F.locate(" ", F.col("sentence"))).withColumn("b", F.locate(" ", F.col("sentence"), 1) + F.length(F.split("sentence", " ").getItem(1)))
    h = T.highlighted(F.col("sentence"), F.col("a"), F.col("b"))
    return s.select("doc_id", "place", h["before"].alias("before"), h["hit"].alias("hit"), h["after"].alias("after"), T.cloze(F.col("sentence"), F.col("a"), F.col("b")).alias("gap"), T.bold(F.col("sentence"), F.col("a"), F.col("b")).alias("bold"), T.escape_html("sentence").alias("html"))


HIGHLIGHT_SQL = WITH + r"""
, h AS (SELECT *, instr(sentence, ' ') AS a, length(string_split(sentence, ' ')[2]) AS n FROM clean)
SELECT doc_id, place, substr(sentence, 1, a) AS before, substr(sentence, a + 1, n) AS hit, substr(sentence, a + n + 1) AS after,
  substr(sentence, 1, a) || '______' || substr(sentence, a + n + 1) AS gap, substr(sentence, 1, a) || '**' || substr(sentence, a + 1, n) || '**' || substr(sentence, a + n + 1) AS bold,
  replace(replace(replace(replace(sentence, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html
FROM h
"""


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return L.headwords(ranks(spark, d).select("word", "freq_rank"))


def folded(spark: SparkSession, d: str) -> DataFrame:
    """STR-02..06, FLT-31: each distinct word of the documents, folded."""
    words = docs(spark, d).select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", T.fold("word").alias("norm"), T.strip_marks("word").alias("bare"), T.looks_vietnamese("word").alias("marked"))


FOLD_SQL = r"""
SELECT word, strip_accents(replace(lower(word), 'đ', 'd')) AS norm, strip_accents(word) AS bare, strip_accents(word) <> word AS marked
FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS word FROM documents) WHERE word <> ''
"""


def prefix_suggest(spark: SparkSession, d: str) -> DataFrame:
    """FLT-20, SRT-01, LKP-18: ten words for every prefix of one and two letters."""
    v = vocabulary(spark, d)
    qs = v.select(F.explode(F.array(F.substring("norm", 1, 1), F.substring("norm", 1, 2))).alias("q")).distinct()
    return L.suggest_english(qs, v)


SUGGEST_SQL = WITH + """
, q AS (SELECT DISTINCT unnest([substr(word, 1, 1), substr(word, 1, 2)]) AS q FROM ranks)
SELECT q, word, place FROM (
  SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY freq_rank, length(word), word) AS place FROM q JOIN ranks ON starts_with(word, q)) WHERE place <= 10
"""


def queries_of(ranked: DataFrame) -> DataFrame:
    """The searches' stated query set, which grows with the vocabulary: of the words of four letters or more those whose rank is divisible
    by 50, misspelt: two letters swapped.  They are held against all words.
    """
    w = F.col("word")
    return ranked.where((F.length("word") >= 4) & (F.col("freq_rank") % 50 == 0)).select(F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), F.substring(w, F.lit(4), F.length(w))).alias("q")).distinct()


def fuzzy_words(spark: SparkSession, d: str) -> DataFrame:
    """LKP-05, FTS-01..03, JOIN-15, STR-08..11, MTH-03."""
    v = vocabulary(spark, d)
    return L.fuzzy(queries_of(v), v, grams(spark, d))


def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    """FLT-23 with the plain edit distance: all words of the vocabulary within two edits."""
    return L.within_two_edits(ranks(spark, d)).select("word", "other", "distance")


EDIT_SQL = WITH + """
, v AS (SELECT word, length(word) AS n FROM ranks),
d1 AS (SELECT word, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS form, i FROM (SELECT word, unnest(range(1, n + 1)) AS i FROM v)),
d2 AS (SELECT word, substr(form, 1, j::INT - 1) || substr(form, j::INT + 1) AS form FROM (SELECT word, form, unnest(range(i, length(form) + 1)) AS j FROM d1)),
f AS (SELECT DISTINCT word, hash(form) AS form FROM (SELECT word, word AS form FROM v UNION ALL SELECT word, form FROM d1 UNION ALL SELECT word, form FROM d2)),
p AS (SELECT DISTINCT a.word, b.word AS other FROM f a JOIN f b USING (form) WHERE a.word < b.word AND abs(length(a.word) - length(b.word)) <= 2)
SELECT word, other, levenshtein(word, other) AS distance FROM p WHERE levenshtein(word, other) <= 2
"""


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    """FTS-01..03, MTH-03, JOIN-16, STR-11, STR-13: the ten best words by shared grams."""
    v = vocabulary(spark, d)
    return L.bm25(queries_of(v), grams(spark, d), 10, digits=5).select("q", "word", "score")


BM25_SQL = WITH + """
, q AS (SELECT DISTINCT substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) AS q FROM ranks WHERE freq_rank % 50 = 0 AND length(word) >= 4),
g AS (SELECT word, length(word) - 2 AS size, substr(word, i::INT, 3) AS gram FROM (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM ranks WHERE length(word) >= 3)),
ix AS (SELECT gram, word, size, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM ix GROUP BY gram),
tot AS (SELECT count(*) AS big, avg(size) AS mean FROM (SELECT DISTINCT word, size FROM ix)),
qa AS (SELECT q, regexp_replace(q, '[^a-z]', '', 'g') AS l FROM q),
qg AS (SELECT DISTINCT q, substr(l, i::INT, 3) AS gram FROM (SELECT q, l, unnest(range(1, length(l) - 1)) AS i FROM qa)),
s AS (
  SELECT q, word, sum(greatest(1e-6, ln((big - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
  FROM qg JOIN ix USING (gram) JOIN df USING (gram), tot GROUP BY q, word)
SELECT q, word, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 5) DESC, word) AS n FROM s) WHERE n <= 10
"""


#: A swap with one edit or swap more on one side of it; parts of one edit have one distance with or without limits on swaps.
_SWAP = """len(list_filter(list_transform(range(3 * (length(q) - 1)), lambda x: [x // 3 + 1, x % 3 - 1]), lambda z: z[1] + z[2] >= 1
  AND substr(word, (z[1] + z[2])::INT, 1) = substr(q, (z[1] + 1)::INT, 1) AND substr(word, (z[1] + z[2] + 1)::INT, 1) = substr(q, z[1]::INT, 1)
  AND damerau_levenshtein(substr(q, 1, (z[1] - 1)::INT), substr(word, 1, (z[1] + z[2] - 1)::INT)) + damerau_levenshtein(substr(q, (z[1] + 2)::INT), substr(word, (z[1] + z[2] + 2)::INT)) <= {})) > 0"""
FUZZY_SQL = BM25_SQL.rpartition("SELECT q, word, round")[0] + f"""
, top AS (SELECT q, word FROM (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, word) AS n FROM s) WHERE n <= {L.CANDIDATES}),
near AS MATERIALIZED (SELECT q.q, word, freq_rank, length(regexp_replace(q.q, '[^a-z]', '', 'g')) AS letters FROM q JOIN ranks ON abs(length(q.q) - length(word)) <= 2 AND damerau_levenshtein(q.q, word) <= 2),
dist AS (SELECT *, CASE WHEN levenshtein(q, word) <= 1 THEN levenshtein(q, word) WHEN {_SWAP.format(0)} THEN 1 WHEN levenshtein(q, word) = 2 OR {_SWAP.format(1)} THEN 2 END AS distance FROM near WHERE letters >= 3),
found AS (SELECT * FROM dist WHERE distance = 1 OR (distance <= 2 AND abs(length(word) - letters) <= 2 AND (q, word) IN (SELECT (q, word) FROM top)))
SELECT q, word, distance::INT AS distance, place::INT AS place FROM (SELECT q, word, distance, row_number() OVER (PARTITION BY q ORDER BY distance, freq_rank, word) AS place FROM found) WHERE place <= 10
"""


def bm25_cost(spark: SparkSession, d: str) -> DataFrame:
    """FTS-02: how many postings the grams of each query of ``bm25_words`` have, and whether its answer needs them all at most twice.

    A query whose first bound is low reads some again; over all queries a fifth is read.
    """
    rows = L.bm25_reads(queries_of(vocabulary(spark, d)), grams(spark, d), 10)
    return rows.select("q", "postings", (F.col("read") <= 2 * F.col("postings")).alias("bounded"))


COST_SQL = WITH + """
, q AS (SELECT DISTINCT substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) AS q FROM ranks WHERE freq_rank % 50 = 0 AND length(word) >= 4),
g AS (SELECT DISTINCT word, substr(word, i::INT, 3) AS gram FROM (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM ranks WHERE length(word) >= 3)),
df AS (SELECT gram, count(*) AS df FROM g GROUP BY gram),
qa AS (SELECT q, regexp_replace(q, '[^a-z]', '', 'g') AS l FROM q),
qg AS (SELECT DISTINCT q, substr(l, i::INT, 3) AS gram FROM (SELECT q, l, unnest(range(1, length(l) - 1)) AS i FROM qa))
SELECT q, sum(df)::BIGINT AS postings, true AS bounded FROM qg JOIN df USING (gram) GROUP BY q
"""


def resolve_ladder(spark: SparkSession, d: str) -> DataFrame:
    """LKP-03, JOIN-04, SRT-08, LKP-19: words of the documents in any case, against the vocabulary and forms that end in s."""
    v = vocabulary(spark, d)
    index = v.where(F.col("word").endswith("s")).join(v.select(F.concat("word", F.lit("s")).alias("word"), F.col("word").alias("headword")), "word").select(F.col("norm").alias("form_norm"), "headword")
    table_ = v.join(index.select(F.col("form_norm").alias("word")).distinct(), "word", "left_anti")
    asked = docs(spark, d).select(F.explode(F.split("text", r"[^\p{L}]+")).alias("q")).where("q <> ''").distinct()
    return L.resolve_english(asked, table_, index).select("q", "step", F.array_join("words", ",").alias("words"))


RESOLVE_SQL = WITH + r"""
, ix AS (SELECT a.word AS form, b.word AS headword FROM ranks a JOIN ranks b ON a.word = b.word || 's'),
hw AS (SELECT word, freq_rank FROM ranks WHERE word NOT IN (SELECT form FROM ix)),
q AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS q FROM documents),
n AS (SELECT q, lower(q) AS l, strip_accents(replace(lower(q), 'đ', 'd')) AS f FROM q WHERE q <> ''),
c AS (
  SELECT q, 1 AS step, word, freq_rank FROM n JOIN hw ON word = q UNION ALL SELECT q, 2, word, freq_rank FROM n JOIN hw ON word = l
  UNION ALL SELECT q, 3, hw.word, hw.freq_rank FROM n JOIN ix ON form = f JOIN hw ON hw.word = ix.headword UNION ALL SELECT q, 4, word, freq_rank FROM n JOIN hw ON word = f),
r AS (SELECT *, row_number() OVER (PARTITION BY q, step ORDER BY freq_rank, word) AS place, min(step) OVER (PARTITION BY q) AS least FROM c)
SELECT q, step, string_agg(word, ',' ORDER BY place) AS words FROM r WHERE step = least AND (place = 1 OR (step = 4 AND place <= 6)) GROUP BY q, step
"""


def shard_hash(spark: SparkSession, d: str) -> DataFrame:
    """MTH-04, MTH-05, O17."""
    return ranks(spark, d).select("word", T.fnv1a32("word").alias("hash"), T.shard("word", 2048).alias("shard"))


SHARD_SQL = WITH + """
SELECT word, h AS hash, (h % 2048)::INT AS shard FROM (
  SELECT word, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(word, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS h FROM ranks)
"""


def prefix_buckets(spark: SparkSession, d: str) -> DataFrame:
    """LKP-16, LKP-17, VAR-25: files of the prefix index and how many words each holds."""
    v = vocabulary(spark, d).withColumn("bytes", F.octet_length("word") + 8)
    return L.prefix_buckets(v, "bytes", 2048).groupBy(L.prefix_file("bucket").alias("file")).agg(F.count("*").alias("n"))


BUCKET_SQL = WITH + """
, a AS (SELECT word, length(word) + 8 AS bytes, regexp_replace(substr(word, 1, 2), '[^a-z_]', '~') AS k FROM ranks),
b AS (SELECT word, bytes, CASE WHEN k NOT LIKE '%~%' AND length(k) = 2 AND length(word) >= 3 AND sum(bytes) OVER (PARTITION BY k) > 2048 THEN regexp_replace(substr(word, 1, 3), '[^a-z_]', '~') ELSE k END AS k FROM a),
c AS (SELECT word, CASE WHEN k NOT LIKE '%~%' AND length(k) = 3 AND length(word) >= 4 AND sum(bytes) OVER (PARTITION BY k) > 2048 THEN regexp_replace(substr(word, 1, 4), '[^a-z_]', '~') ELSE k END AS k FROM b)
SELECT CASE WHEN k IN ('con', 'prn', 'aux', 'nul') THEN k || '-' ELSE k END AS file, count(*) AS n FROM c GROUP BY 1
"""


def phrase_contains(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-23, FLT-22: all runs of three words of benchmark texts (whole texts of fewer), and the shortest sentences of documents that hold them."""
    from wordloom.operators.bilingual import pairs_by_phrase

    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 3), " "))
    phrases = table(spark, d, "benchmark").select(words.alias("w")).select(F.explode(runs).alias("word")).where("word <> ''")
    pairs = C.clean_sentences(docs(spark, d)).select(F.concat_ws(":", "doc_id", "place").alias("tid"), F.col("sentence").alias("en"), F.col("sentence").alias("vi"))
    return pairs_by_phrase(pairs, phrases, 3)


PHRASE_SQL = WITH + r"""
, bw AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT list_aggregate(list_slice(w, i, i + 2), 'string_agg', ' ') AS phrase FROM (SELECT w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM bw) WHERE len(w) > 0),
s AS (SELECT doc_id::VARCHAR || ':' || place::VARCHAR AS tid, length(sentence) AS n, ' ' || list_aggregate(list_filter(regexp_split_to_array(lower(sentence), '[^\p{L}\p{M}]+'), lambda x: x <> ''), 'string_agg', ' ') || ' ' AS t FROM clean)
SELECT phrase, tid FROM (SELECT phrase, tid, row_number() OVER (PARTITION BY phrase ORDER BY n, tid) AS k FROM p JOIN s ON contains(t, ' ' || phrase || ' ')) WHERE k <= 5
"""


def gram_matches(spark: SparkSession, d: str) -> DataFrame:
    """FTS-04: how many words an index's own search would find for each query."""
    v = vocabulary(spark, d)
    return L.gram_matches(queries_of(v), v)


MATCHES_SQL = WITH + """
, q AS (SELECT DISTINCT substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) AS q FROM ranks WHERE freq_rank % 50 = 0 AND length(word) >= 4),
g AS (SELECT DISTINCT word, substr(word, i::INT, 3) AS gram FROM (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM ranks WHERE length(word) >= 3)),
qa AS (SELECT q, regexp_replace(q, '[^a-z]', '', 'g') AS l FROM q),
qg AS (SELECT DISTINCT q, substr(l, i::INT, 3) AS gram FROM (SELECT q, l, unnest(range(1, length(l) - 1)) AS i FROM qa))
SELECT q, count(DISTINCT word) AS n FROM qg JOIN g USING (gram) GROUP BY q
"""


def prefix_load(spark: SparkSession, d: str) -> DataFrame:
    """VAR-28: words of documents as a prefix file keeps them, and their norms made again."""
    w = docs(spark, d).select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where("word <> ''").distinct().withColumn("norm", T.strip_marks("word"))
    stored = L.stored_prefix(w)
    return L.loaded_prefix(stored).join(stored.select("word", F.col("norm").alias("kept")), "word")


PREFIX_SQL = r"""
WITH w AS (SELECT word, strip_accents(word) AS norm FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS word FROM documents) WHERE word <> '')
SELECT word, norm, CASE WHEN norm <> strip_accents(replace(lower(word), 'đ', 'd')) THEN norm END AS kept FROM w
"""


def partial_counts(spark: SparkSession, d: str) -> DataFrame:
    """BAT-03, AGG-07, BAT-01: counts by chunk kept as partitions, half of them there before; words seen five times or more."""
    from wordloom.plans.export_queries import folder

    at = folder(spark)
    s = C.chunked(C.clean_sentences(docs(spark, d)), [F.asc("doc_id"), F.asc("place")], 500)
    C.partial_counts(s.where("chunk % 2 = 0"), at)
    return C.kept_counts(C.partial_counts(s, at))


def heavy_words(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07: words that make up a 500th or more of all, by a summary of bounded size; whether their counts are within its bound."""
    counts = ranks(spark, d).select("word", "n")
    found = C.heavy_words(C.clean_sentences(docs(spark, d)), 0.002).join(counts, "word")
    total = counts.agg(F.sum("n").alias("_total"))
    return found.join(F.broadcast(total), F.lit(True)).where(F.col("n") >= 0.002 * F.col("_total")).select("word", "n", F.col("n").between(F.col("estimate"), F.col("estimate") + F.col("bound")).alias("bounded"))


HEAVY_SQL = WITH + "SELECT word, n, true AS bounded FROM counts WHERE n >= 0.002 * (SELECT sum(n) FROM counts)"


def ordered_words(spark: SparkSession, d: str) -> DataFrame:
    """SRT-13, MTH-01, STR-12: words in code-point order, with rounded figures and letters of one mark folded."""
    from wordloom.operators.relational import global_rank

    w = docs(spark, d).select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return global_rank(w, [F.asc("word")], "place").select("word", "place", F.round(F.log2("n"), 4).alias("bits"), F.ceil(F.col("n") / 3).alias("thirds"), F.greatest(F.length("word"), "n").alias("most"), T.fold_single_marks("word").alias("single"))


ORDERED_SQL = r"""
WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1)
SELECT word, row_number() OVER (ORDER BY word) AS place, round(log2(n), 4) AS bits, ceil(n / 3)::BIGINT AS thirds, greatest(length(word), n) AS most, translate(lower(word), 'MANY', 'ONE') AS single FROM w
""".replace("MANY", T.single_mark_map()[0]).replace("ONE", T.single_mark_map()[1])


def round_robin_report(spark: SparkSession, d: str) -> DataFrame:
    """WIN-15: fifty documents, in turn from each source."""
    return round_robin(docs(spark, d).select("source", "doc_id"), "source", [F.asc("doc_id")], 50)


ROBIN_SQL = """
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS t FROM documents) ORDER BY t, source LIMIT 50
"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """BAT-01: sentences in chunks of 1000, with each chunk's first and last place."""
    s = C.chunked(C.clean_sentences(docs(spark, d)), [F.asc("doc_id"), F.asc("place")], 1000)
    return s.groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


CHUNK_SQL = WITH + """
SELECT chunk, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id, place) - 1) // 1000)::INT AS chunk FROM clean) GROUP BY chunk
"""


def pieces_of_html(spark: SparkSession, d: str) -> DataFrame:
    """STR-29, STR-31, STR-33, VAR-30 on raw pages: file name, escaped page, number of words."""
    p = table(spark, d, "pages")
    return p.select("page_id", T.safe_file_name("url").alias("file"), T.escape_html("html").alias("start"), T.url_encode("url").alias("encoded"), F.size(T.split_white("html")).alias("words"))


HTML_SQL = r"""
SELECT page_id, regexp_replace(url, '[^\p{L}\p{N} _\-]', '_', 'g') AS file,
  replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS start, url_encode(url) AS encoded,
  len(list_filter(string_split_regex(html, '[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')) AS words
FROM pages
"""

QUERIES = {
    "sentence_dedup": (sentence_dedup, WITH + "SELECT doc_id, place, sentence FROM clean"),
    "freq_rank": (ranks, RANKS_SQL),
    "band_sample": (band_sample, BAND_SAMPLE_SQL),
    "draw_one_each": (one_each, ONE_EACH_SQL),
    "collocation_logdice": (logdice, LOGDICE_SQL),
    "collocation_ranked": (ranked_collocations, RANKED_SQL),
    "reject_reasons": (reject_reasons, REJECT_SQL),
    "good_examples": (good_examples, EXAMPLES_SQL),
    "sentence_flags": (text_flags, FLAGS_SQL),
    "highlight_views": (highlights, HIGHLIGHT_SQL),
    "fold_words": (folded, FOLD_SQL),
    "prefix_suggest": (prefix_suggest, SUGGEST_SQL),
    "fuzzy_osa": (fuzzy_words, FUZZY_SQL),
    "fuzzy_lev": (edit_distances, EDIT_SQL),
    "bm25_words": (bm25_scores, BM25_SQL),
    "resolve_ladder": (resolve_ladder, RESOLVE_SQL),
    "shard_hash": (shard_hash, SHARD_SQL),
    "prefix_buckets": (prefix_buckets, BUCKET_SQL),
    "phrase_contains": (phrase_contains, PHRASE_SQL),
    "gram_matches": (gram_matches, MATCHES_SQL),
    "bm25_cost": (bm25_cost, COST_SQL),
    "prefix_load": (prefix_load, PREFIX_SQL),
    "partial_counts": (partial_counts, WITH + "SELECT word, n FROM counts WHERE n >= 5"),
    "heavy_words": (heavy_words, HEAVY_SQL),
    "ordered_words": (ordered_words, ORDERED_SQL),
    "round_robin": (round_robin_report, ROBIN_SQL),
    "sentence_chunks": (chunks, CHUNK_SQL),
    "page_text": (pieces_of_html, HTML_SQL),
}
