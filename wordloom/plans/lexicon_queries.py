"""Queries that build the lexicon: parts stand for a dictionary dump's documents, made by rule in Spark and in the twins alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import bilingual as B
from wordloom.operators import lexicon as X
from wordloom.operators import relational as R
from wordloom.operators import reports as P
from wordloom.plans.corpus_queries import table


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the two words of their names and a headword made of them."""
    p = table(spark, d, "part").withColumn("a", F.split("p_name", " ")[0]).withColumn("b", F.split("p_name", " ")[1])
    return p.withColumn("word", F.expr("CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN b || ' up' WHEN 4 THEN initcap(a) ELSE b || ' of ' || a END"))


def dump(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary document for each part, in the shape of ``readers.DICTIONARY``."""
    p = _parts(spark, d)
    senses = """transform(sequence(0, p_size % 3), j -> named_struct(
      'glosses', CASE WHEN (p_partkey + j) % 7 = 0 THEN cast(array() AS array<string>) ELSE array('short', lower(p_type) || ' ' || j) END,
      'tags', CASE (p_partkey + j) % 5 WHEN 0 THEN array('obsolete') WHEN 1 THEN array('countable', 'UK') WHEN 2 THEN array('form-of', 'plural') WHEN 4 THEN cast(array() AS array<string>) END,
      'form_of', CASE WHEN (p_partkey + j) % 5 = 2 THEN array(named_struct('word', a)) END, 'alt_of', CASE WHEN (p_partkey + j) % 5 = 4 THEN array(named_struct('word', b)) END,
      'examples', CASE WHEN j = 0 THEN array(named_struct('text', 'Ex ' || p_partkey, 'type', 'example'), named_struct('text', 'Said', 'type', 'quotation')) END,
      'translations', CASE WHEN p_partkey % 4 = 0 THEN array(named_struct('code', 'vi', 'word', 'từ ' || p_size, 'sense', ''), named_struct('code', 'fr', 'word', 'mot', 'sense', 'x')) END))"""
    return p.selectExpr(
        "p_partkey AS place", "word", "CASE WHEN p_partkey % 17 = 0 THEN 'vi' ELSE 'en' END AS lang_code",
        "element_at(array('noun', 'verb', 'adjective', 'name', 'adverb', 'phrasal verb'), p_size % 6 + 1) AS pos", f"{senses} AS senses",
        """array(named_struct('form', word || 's', 'tags', array('plural'), 'source', cast(NULL AS string)), named_struct('form', '-', 'tags', cast(NULL AS array<string>), 'source', cast(NULL AS string)),
          named_struct('form', word || 'ed', 'tags', array('archaic'), 'source', 't'), named_struct('form', word, 'tags', cast(NULL AS array<string>), 'source', cast(NULL AS string)),
          named_struct('form', b || 'ing', 'tags', cast(NULL AS array<string>), 'source', 'conj')) AS forms""",
        "array(named_struct('ipa', '/s' || p_size || '/', 'tags', array(if(p_size % 2 = 0, 'UK', 'US')), 'audio', cast(NULL AS string)), named_struct('ipa', '[x]', 'tags', cast(NULL AS array<string>), 'audio', cast(NULL AS string)), named_struct('ipa', '/any' || p_size || '/', 'tags', cast(NULL AS array<string>), 'audio', cast(NULL AS string))) AS sounds",
        r"CASE WHEN p_size % 5 <> 0 THEN 'Etymology tree\n├ x\n\nFrom ' || p_type || '.\n More. \nThird.' END AS etymology_text",
        "CASE WHEN p_partkey % 3 = 0 THEN array(named_struct('code', 'vi', 'word', 'chữ', 'sense', 's' || p_size), named_struct('code', 'vi', 'word', '', 'sense', 'none')) END AS translations",
        "array(named_struct('word', b), named_struct('word', p_name), named_struct('word', a || b)) AS derived",
    )


def core(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).where("p_partkey % 2 = 0").select(F.col("b").alias("word")).distinct()


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).groupBy(F.col("a").alias("word")).agg(F.min("p_partkey").alias("freq_rank"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    vi = _parts(spark, d).where("p_partkey % 5 = 1").select("word")
    return X.english_entries(dump(spark, d), core(spark, d), ranked(spark, d), vi)


def _lit(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


DUMP = f"""
p AS (SELECT *, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part),
q AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN b || ' up' WHEN 4 THEN upper(a[1]) || lower(a[2:]) ELSE b || ' of ' || a END AS word FROM p),
dump AS (
  SELECT p_partkey AS place, word, CASE WHEN p_partkey % 17 = 0 THEN 'vi' ELSE 'en' END AS lang_code, ['noun', 'verb', 'adj', 'name', 'adv', 'verb'][p_size % 6 + 1] AS pos,
    list_transform(range(0, p_size % 3 + 1), lambda j: {{
      'glosses': CASE WHEN (p_partkey + j) % 7 = 0 THEN []::VARCHAR[] ELSE ['short', lower(p_type) || ' ' || j] END,
      'tags': CASE (p_partkey + j) % 5 WHEN 0 THEN ['obsolete'] WHEN 1 THEN ['countable', 'UK'] WHEN 2 THEN ['form-of', 'plural'] WHEN 4 THEN []::VARCHAR[] END,
      'form_of': CASE WHEN (p_partkey + j) % 5 = 2 THEN a END, 'alt_of': CASE WHEN (p_partkey + j) % 5 = 4 THEN b END,
      'example': CASE WHEN j = 0 THEN 'Ex ' || p_partkey END, 'vi': CASE WHEN p_partkey % 4 = 0 THEN 'từ ' || p_size END}}) AS senses,
    [word || 's', b || 'ing'] AS forms, '/s' || p_size || '/' AS ipa, p_size % 2 = 0 AS uk, '/any' || p_size || '/' AS ipa_any,
    CASE WHEN p_size % 5 <> 0 THEN 'From ' || p_type || '. More.' END AS etymology, CASE WHEN p_partkey % 3 = 0 THEN 's' || p_size END AS vi, [b, a || b] AS derived, p_size
  FROM q),
core AS (SELECT DISTINCT b AS word FROM p WHERE p_partkey % 2 = 0), ranked AS (SELECT a AS word, min(p_partkey) AS freq_rank FROM p GROUP BY 1), viw AS (SELECT DISTINCT word FROM q WHERE p_partkey % 5 = 1)
"""
ENTRIES = DUMP + f""",
g AS (SELECT *, list_filter(senses, lambda s: len(s.glosses) > 0 AND NOT coalesce(list_has_any(s.tags, [{_lit(X.SKIP_TAGS)}]), false)) AS good, string_split(word, ' ') AS parts,
    CASE WHEN vi IS NULL THEN 0 ELSE 2 END + CASE WHEN senses[1].vi IS NULL THEN 0 ELSE 2 * len(senses) END AS n_tr
  FROM dump WHERE lang_code = 'en' AND pos NOT IN ({_lit(X.SKIP_POS)})),
h AS (SELECT *, list_sort(list_intersect(list_transform(parts, lambda x: lower(x)), cw)) AS ct, list_contains(cw, lower(parts[1])) AS leads, n_tr + 3 * len(good) AS popularity
  FROM g, (SELECT list(word) AS cw FROM core) WHERE len(good) > 0),
i AS (SELECT *, len(parts) > 1 AND pos IN ({_lit(X.PHRASE_POS)}) AND len(ct) > 0 AS phrase FROM h),
k AS (SELECT *, CASE WHEN phrase AND pos = 'verb' AND len(parts) <= 3 AND leads AND len(list_filter(parts[2:], lambda x: x NOT IN ({_lit(X.PARTICLES)}))) = 0 THEN 'phrasal_verb' WHEN phrase THEN 'idiom' END AS kind FROM i
  WHERE phrase OR n_tr >= 5 OR word IN (SELECT word FROM core) OR word IN (SELECT word FROM ranked) OR word IN (SELECT word FROM viw)),
entries AS (
  SELECT word, pos, min(place) AS place, arg_min(coalesce(kind, CASE WHEN len(parts) > 1 THEN 'phrase' ELSE 'word' END), place) AS entry_type, first(kind ORDER BY place) AS kind,
    first(CASE WHEN len(parts) > 1 AND len(ct) > 0 THEN ct END ORDER BY place) AS core_tokens, arg_min(popularity, place) AS popularity, flatten(list(good ORDER BY place)) AS senses,
    flatten(list(forms ORDER BY place)) AS forms, arg_min(ipa, place) FILTER (uk) AS ipa_uk, arg_min(ipa, place) FILTER (NOT uk) AS ipa_us, arg_min(ipa_any, place) AS ipa_any,
    arg_min(etymology, place) FILTER (etymology IS NOT NULL) AS etymology, list_sort(list_distinct(flatten(list(derived)))) AS derived,
    flatten(list(list_concat(CASE WHEN vi IS NULL THEN []::VARCHAR[] ELSE [vi || '=chữ'] END, list_transform(list_filter(senses, lambda s: len(s.glosses) > 0 AND s.vi IS NOT NULL), lambda s: s.glosses[-1] || '=' || s.vi)) ORDER BY place)) AS vi
  FROM k GROUP BY word, pos)
"""


def english_entries(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03, FLT-07..14, AGG-30, NST-01..03, LNG-08, SET-05, WIN-14, VAR-06, VAR-07, STR-20..22: merged entries, their parts as text."""
    joined = lambda c, text: F.array_join(F.transform(c, text), "; ")
    sense = lambda s: F.concat_ws("/", s["gloss"], F.array_join(s["tags"], "+"), F.array_join(s["examples"], "+"), T.grammar_codes(s["tags"]), T.usage_labels(s["tags"]))
    return entries(spark, d).select(
        "word", "pos", "place", "entry_type", "kind", F.array_join("core_tokens", ",").alias("core_tokens"), "popularity", F.size("senses").alias("n_senses"), joined("senses", sense).alias("senses"),
        joined(F.transform("forms", lambda f: f["form"]), lambda f: f).alias("forms"), F.array_join(X.shown_forms(F.col("forms"), 3), ", ").alias("shown"), "ipa_uk", "ipa_us", "ipa_any", "etymology",
        F.array_join("derived", ",").alias("derived"), joined("vi", lambda v: F.concat_ws("=", v["header"], v["word"])).alias("vi"),
    )


ENTRIES_SQL = "WITH " + ENTRIES + """,
f AS (SELECT *, list_filter(forms, lambda x, i: list_position(forms, x) = i) AS fs FROM entries)
SELECT word, pos, place, entry_type, kind, array_to_string(core_tokens, ',') AS core_tokens, popularity, len(senses)::INT AS n_senses,
  array_to_string(list_transform(senses, lambda s: s.glosses[-1] || '/' || array_to_string(coalesce(s.tags, []), '+') || '/' || coalesce(s.example, '') || CASE WHEN list_contains(coalesce(s.tags, []), 'countable') THEN '/[C]/UK' ELSE '//' END), '; ') AS senses,
  array_to_string(fs, '; ') AS forms, array_to_string(list_filter(fs, lambda x: right(x, 3) <> 'ing')[:3], ', ') AS shown, ipa_uk, ipa_us, ipa_any, etymology, array_to_string(derived, ',') AS derived, array_to_string(vi, '; ') AS vi
FROM f
"""


def form_links(spark: SparkSession, d: str) -> DataFrame:
    """NST-01, JOIN-10, SRC-20: forms and variants whose targets are headwords, and the surface forms of each lemma."""
    hw = entries(spark, d).select("word").distinct()
    index = X.lookup_index(X.form_links(dump(spark, d)), hw)
    rows = index.select(F.lit("index").alias("part"), "form_norm", "headword", "relation", F.array_join("tags", ",").alias("tags"))
    surface = X.surface_forms(index, hw.select(F.col("word").alias("lemma"))).select(F.lit("surface").alias("part"), F.col("form").alias("form_norm"), F.col("lemma").alias("headword"), F.lit("").alias("relation"), F.lit("").alias("tags"))
    return rows.unionByName(surface)


LINKS_SQL = "WITH " + ENTRIES + f""",
s AS (SELECT word, unnest(senses) AS s FROM dump WHERE lang_code = 'en' AND pos NOT IN ({_lit(X.SKIP_POS)})),
l AS (SELECT word AS form, s.form_of AS target, 'inflection' AS relation, 'plural' AS tags FROM s WHERE s.form_of IS NOT NULL UNION SELECT word, s.alt_of, 'variant', '' FROM s WHERE s.alt_of IS NOT NULL),
x AS (SELECT lower(form) AS form_norm, target AS headword, relation, tags FROM l WHERE form <> target AND target IN (SELECT word FROM entries) AND form NOT IN (SELECT word FROM entries))
SELECT 'index' AS part, * FROM x
UNION ALL SELECT 'surface', form, lemma, '', '' FROM (SELECT headword AS lemma, form_norm AS form FROM x WHERE relation = 'inflection' AND regexp_matches(form_norm, '^\\p{{L}}+$') UNION SELECT word, word FROM entries)
"""


def word_relations(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-21, SET-07, WIN-13, JOIN-05, FLT-28: phrases of core words, and derived words that are headwords."""
    e = entries(spark, d)
    phrases = X.phrase_links(e).select(F.lit("phrase").alias("part"), "headword", F.col("phrase").alias("word"), "kind", "gloss", "popularity")
    family = X.family(e, e.select("word").distinct()).select(F.lit("family").alias("part"), "headword", F.col("member").alias("word"), F.lit("").alias("kind"), F.lit("").alias("gloss"), F.lit(0).cast("bigint").alias("popularity"))
    return phrases.unionByName(family)


RELATIONS_SQL = "WITH " + ENTRIES + """,
f AS (SELECT unnest(core_tokens) AS headword, word, kind, senses[1].glosses[-1] AS gloss, popularity, place FROM entries WHERE kind IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY headword, word ORDER BY place) AS k FROM f)
SELECT 'phrase' AS part, headword, word, kind, gloss, popularity::BIGINT AS popularity FROM o WHERE k = 1
UNION ALL SELECT DISTINCT 'family', word, m, '', '', 0 FROM (SELECT word, unnest(derived) AS m FROM entries) WHERE word <> m AND m IN (SELECT word FROM entries)
"""


def source_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, AGG-16, VAR-11, VAR-12: what the dump has of each word."""
    return X.source_statistics(dump(spark, d))


STATISTICS_SQL = "WITH " + DUMP + f"""
SELECT word, count(*) AS entries, sum(len(list_filter(senses, lambda s: len(s.glosses) > 0 AND NOT coalesce(list_has_any(s.tags, [{_lit(X.SKIP_TAGS)}]), false))))::BIGINT AS senses,
  count(DISTINCT p_size % 6) AS pos, true AS has_sound, true AS has_forms, bool_or(vi IS NOT NULL) AS has_translations, bool_or(len(list_filter(senses, lambda s: len(s.glosses) > 0 AND NOT coalesce(list_contains(s.tags, 'form-of'), false))) > 0) AS is_lemma
FROM dump GROUP BY word
"""


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-11, AGG-15, AGG-17, VAR-14, VAR-15: entries with rank, band, level, model and tier."""
    levels = _parts(spark, d).selectExpr("CASE WHEN p_partkey % 3 = 0 THEN a || '/ ' || b ELSE b END AS headword", "element_at(array('noun', 'verb', 'adjective'), p_size % 3 + 1) AS pos", "element_at(array('A1', ' b1', 'C2', 'X'), p_size % 4 + 1) AS CEFR")
    ai = _parts(spark, d).where("p_partkey % 2 = 0").selectExpr("b AS word", "'noun' AS pos", "'m' AS model").distinct()
    out = X.enriched(entries(spark, d).select("word", "pos"), ranked(spark, d), X.cefr_levels(levels), ai, core(spark, d)).select("word", "pos", "freq_rank", "cefr", "ai_model", "freq_band", "tier")
    histogram = X.cefr_histogram(levels).select(F.lit("all").alias("word"), F.col("CEFR").alias("pos"), F.col("n").alias("freq_rank"), *[F.lit(None).cast("string").alias(c) for c in ("cefr", "ai_model", "freq_band", "tier")])
    return out.unionByName(histogram)


ENRICHED_SQL = "WITH " + ENTRIES + """,
v AS (SELECT unnest(CASE WHEN p_partkey % 3 = 0 THEN [a, b] ELSE [b] END) AS word, ['noun', 'verb', 'adj'][p_size % 3 + 1] AS pos, ['A1', 'B1', 'C2', 'X'][p_size % 4 + 1] AS c FROM p),
c AS (SELECT word, pos, min(c) AS cefr FROM v WHERE c <> 'X' GROUP BY ALL)
SELECT e.word, e.pos, r.freq_rank, c.cefr, CASE WHEN e.pos = 'noun' AND t.word IS NOT NULL THEN 'm' END AS ai_model, CASE WHEN freq_rank <= 3000 THEN 'Top 3000' WHEN freq_rank <= 5000 THEN 'Top 5000' END AS freq_band, CASE WHEN t.word IS NULL THEN 'B' ELSE 'A' END AS tier
FROM entries e LEFT JOIN ranked r USING (word) LEFT JOIN c ON c.word = e.word AND c.pos = e.pos LEFT JOIN core t ON t.word = e.word
UNION ALL SELECT 'all', ['A1', ' b1', 'C2', 'X'][p_size % 4 + 1], count(*), NULL, NULL, NULL, NULL FROM p GROUP BY 2
"""


def frequency_list(spark: SparkSession, d: str) -> DataFrame:
    """AGG-08, WIN-01, VAR-01..04: ranks from two frequency columns, with and without new numbers, and ranks anew without inflected forms."""
    rows = _parts(spark, d).select(F.lower("word").alias("word"), F.when(F.col("p_size") % 4 == 0, "0").when(F.col("p_size") % 4 == 1, "").otherwise(F.col("p_partkey").cast("string")).alias("bnc"), F.when(F.col("p_size") % 3 == 0, "0").otherwise((F.col("p_size") * 7).cast("string")).alias("frq"))
    all_ = X.frequency_ranks(rows)
    raw = X.frequency_ranks(rows, X.CORE_WORD, renumber=False).withColumnRenamed("freq_rank", "raw")
    again = X.rerank_without(all_, rows.where("word LIKE '% up'").select("word").distinct()).withColumnRenamed("freq_rank", "again")
    return all_.join(raw, "word", "left").join(again, "word", "left").select("word", "freq_rank", "raw", "again")


FREQUENCY_SQL = "WITH " + DUMP + """,
r AS (SELECT lower(word) AS word, CASE WHEN p_size % 4 > 1 THEN p_partkey END AS bnc, CASE WHEN p_size % 3 <> 0 THEN p_size * 7 END AS frq FROM q),
m AS (SELECT word, min(least(nullif(bnc, 0), nullif(frq, 0))) AS least FROM r GROUP BY word HAVING least IS NOT NULL),
a AS (SELECT word, least, row_number() OVER (ORDER BY least, word) AS freq_rank FROM m),
b AS (SELECT word, row_number() OVER (ORDER BY freq_rank) AS again FROM a WHERE NOT ends_with(word, ' up'))
SELECT a.word, freq_rank, CASE WHEN regexp_matches(a.word, '^[a-z]+$') THEN least END AS raw, again FROM a LEFT JOIN b USING (word)
"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """WIN-16, NST-14: each word's senses numbered across its entries, as one text."""
    e = entries(spark, d).select("word", F.col("place").alias("entry"), "pos", F.posexplode("senses").alias("sense", "s"))
    return P.prompt_text(X.numbered_senses(e).select("word", "pos", "number", F.col("s.gloss").alias("gloss")))


PROMPTS_SQL = "WITH " + ENTRIES + """,
s AS (SELECT word, pos, place, unnest(list_transform(senses, lambda s: s.glosses[-1])) AS gloss, generate_subscripts(senses, 1) AS k FROM entries),
n AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY place, k) AS number FROM s)
SELECT word, string_agg(number || '. [' || pos || '] ' || gloss, chr(10) ORDER BY number) AS payload FROM n GROUP BY word
"""


def source_senses(spark: SparkSession, d: str) -> DataFrame:
    """BAT-13, BAT-14, VAR-05: core words' entries and senses with one example, all glosses, and the phrases that hold them."""
    rows, want = dump(spark, d), core(spark, d)
    c, s = X.collected(rows, rows, want), X.scanned(rows, want)
    sense = lambda x: F.concat_ws("/", x["gloss"], F.array_join(x["tags"], "+"), F.coalesce(x["ex"], F.lit("-")))
    return c.join(s.withColumnRenamed("entries", "n"), "word").select(
        "word", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["pos"], F.array_join(F.transform(e["senses"], sense), ","))), "; ").alias("entries"), F.array_join(F.transform("glosses", lambda g: g["gloss"]), "; ").alias("glosses"), "n",
        F.array_join(F.transform("phrases", lambda p: F.concat_ws(":", p["phrase"], p["pos"], p["kind"], p["gloss"], p["popularity"])), "; ").alias("phrases"),
    )


SOURCE_SQL = "WITH " + DUMP + f""",
u AS (SELECT *, list_filter(senses, lambda s: len(s.glosses) > 0 AND NOT coalesce(list_has_any(s.tags, [{_lit(X.SKIP_TAGS)}]), false)) AS good, string_split(word, ' ') AS parts, CASE WHEN vi IS NULL THEN 0 ELSE 2 END AS tr FROM dump WHERE lang_code = 'en' AND pos NOT IN ({_lit(X.SKIP_POS)})),
e AS (SELECT word, string_agg(pos || ':' || array_to_string(list_transform(good, lambda s: s.glosses[-1] || '/' || array_to_string(list_sort(coalesce(s.tags, [])), '+') || '/' || coalesce(s.example, '-')), ','), '; ' ORDER BY place) AS entries, count(*) AS n FROM u WHERE len(good) > 0 GROUP BY word),
g AS (SELECT word, array_to_string(flatten(list(flatten(list_transform(senses, lambda s: s.glosses)) ORDER BY place)), '; ') AS glosses FROM dump WHERE lang_code = 'en' GROUP BY word),
f AS (SELECT word AS phrase, raw_pos, place, good[1].glosses[-1] AS gloss, tr + 3 * len(good) AS popularity, parts, unnest(list_distinct(parts)) AS t FROM (SELECT *, ['noun', 'verb', 'adjective', 'name', 'adverb', 'phrasal verb'][p_size % 6 + 1] AS raw_pos FROM u) WHERE len(good) > 0 AND len(parts) > 1),
h AS (SELECT t AS word, string_agg(phrase || ':' || raw_pos || ':' || CASE WHEN raw_pos = 'verb' AND len(parts) <= 3 AND parts[1] = t AND len(list_filter(parts[2:], lambda x: x NOT IN ({_lit(X.PARTICLES)}))) = 0 THEN 'phrasal_verb' ELSE 'idiom' END || ':' || gloss || ':' || popularity, '; ' ORDER BY place) AS phrases FROM f WHERE t <> phrase GROUP BY t)
SELECT core.word, entries, CASE WHEN glosses IS NULL THEN NULL ELSE glosses END AS glosses, coalesce(n, 0) AS n, phrases FROM core LEFT JOIN e USING (word) LEFT JOIN g USING (word) LEFT JOIN h USING (word)
"""


def validated(spark: SparkSession, d: str) -> DataFrame:
    """NST-05, BAT-09, SRC-21, SRC-22: model results against their sources: good senses, and rejects with a reason."""
    e = entries(spark, d)
    sources = e.select("word", "pos", F.size("senses").alias("n"))
    results = _parts(spark, d).selectExpr(
        "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE word END AS word", "CASE WHEN p_partkey % 13 = 0 THEN '' ELSE element_at(array('noun', 'verb', 'adjective', 'noun', 'adverb', 'verb'), p_size % 6 + 1) END AS pos",
        "p_size % 3 AS pass", "lpad(p_partkey, 9, '0') AS file", "p_size % 2 AS priority",
        """CASE WHEN p_partkey % 19 <> 0 THEN transform(sequence(1, 2), j -> named_struct('src', array(cast(p_partkey % 4 + j - 1 AS int)), 'guideword', 'g', 'grammar', '', 'labels', '',
          'definition', CASE WHEN (p_partkey + j) % 9 = 0 THEN ' ' ELSE 'def ' || p_size END, 'vi', 'v', 'cefr', 'A1', 'examples', cast(array() AS array<struct<en:string,vi:string>>))) END AS senses""",
    )
    good, bad = X.validated(X.latest_results(results.where("word IS NOT NULL AND pos <> ''")).unionByName(results.where("word IS NULL OR pos = ''")).drop("pass", "file", "priority"), sources)
    shown = good.select("word", "pos", F.array_join(F.transform("senses", lambda s: F.concat_ws(":", s["definition"], F.array_join(s["src"].cast("array<string>"), "+"))), "; ").alias("what"))
    first = X.preferred_results(results.where("word IS NOT NULL")).select("word", "pos", F.concat(F.lit("file "), "file").alias("what"))
    return shown.unionByName(bad.select("word", "pos", F.col("reason").alias("what"))).unionByName(first)


VALIDATED_SQL = "WITH " + ENTRIES + """,
src AS (SELECT word, pos, len(senses) AS n FROM entries), tot AS (SELECT word, sum(n) AS total FROM src GROUP BY 1),
res AS (
  SELECT CASE WHEN p_partkey % 11 <> 0 THEN word END AS word, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE ['noun', 'verb', 'adjective', 'noun', 'adverb', 'verb'][p_size % 6 + 1] END AS raw, p_size % 3 AS pass, lpad(p_partkey::VARCHAR, 9, '0') AS file, p_size % 2 AS priority,
    CASE WHEN p_partkey % 19 <> 0 THEN list_transform([1, 2], lambda j: {'src': p_partkey % 4 + j - 1, 'def': CASE WHEN (p_partkey + j) % 9 = 0 THEN ' ' ELSE 'def ' || p_size END}) END AS senses FROM q),
lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, raw ORDER BY pass DESC, file DESC) AS k FROM res WHERE word IS NOT NULL AND raw <> '') WHERE k = 1 UNION ALL SELECT *, 1 FROM res WHERE word IS NULL OR raw = ''),
r AS (SELECT l.word, CASE raw WHEN 'adjective' THEN 'adj' WHEN 'adverb' THEN 'adv' ELSE raw END AS pos, senses, total FROM lat l LEFT JOIN tot USING (word)),
v AS (SELECT r.*, CASE WHEN r.word IS NULL OR r.pos = '' OR senses IS NULL THEN 'word, pos or senses missing' WHEN s.word IS NULL THEN 'not in the input' END AS reason,
  list_filter(senses, lambda s: trim(s.def) <> '' AND s.src BETWEEN 1 AND total) AS good FROM r LEFT JOIN src s ON s.word = r.word AND s.pos = r.pos)
SELECT word, pos, array_to_string(list_transform(good, lambda s: s.def || ':' || s.src), '; ') AS what FROM v WHERE reason IS NULL
UNION ALL SELECT word, pos, reason FROM v WHERE reason IS NOT NULL
UNION ALL SELECT word, pos, 'senses without definition or source' FROM v WHERE reason IS NULL AND len(good) < len(senses)
UNION ALL SELECT word, raw, 'file ' || file FROM (SELECT *, row_number() OVER (PARTITION BY word, raw ORDER BY priority, file) AS k FROM res WHERE word IS NOT NULL) WHERE k = 1
"""


def vietnamese(spark: SparkSession, d: str) -> DataFrame:
    """SRC-04, SRC-05, STR-17, NST-08, VAR-08..10, AGG-26: blocks, numbered senses, links of glosses and runs of one part of speech."""
    rows = dump(spark, d).select("word", "lang_code", "pos", "place", "senses")
    blocks = B.vietnamese_blocks(rows).select(F.lit("block").alias("part"), "word", "pos", F.array_join("glosses", "; ").alias("what"))
    senses = B.vietnamese_senses(rows)
    numbered = senses.select(F.lit("sense").alias("part"), "word", "pos", F.concat_ws(":", "place", "ord", "gloss").alias("what"))
    runs = B.sense_runs(senses).select(F.lit("run").alias("part"), "word", "pos", F.concat_ws(":", "run", F.array_join("glosses", "; ")).alias("what"))
    links = B.links_of(_parts(spark, d).selectExpr("b AS headword", "'noun' AS pos", "a AS guideword", "p_type AS definition", "p_name || ' (x); ' || lower(p_type) || ', một hai ba bốn năm' AS vi"), "wiktionary")
    return blocks.unionByName(numbered).unionByName(runs).unionByName(links.groupBy(F.lit("link").alias("part"), F.col("vi").alias("word"), "pos").agg(F.concat_ws(":", F.count("*"), F.max("weight"), F.max("guideword"), F.max("source")).alias("what")))


VIETNAMESE_SQL = "WITH " + DUMP + f""",
al AS (SELECT word, pos, place, list_filter(flatten(list_transform(senses, lambda s: s.glosses)), lambda g: g <> '') AS gl FROM dump WHERE lang_code = 'en'),
sn AS (SELECT place, lower(word) AS word, pos, list_transform(list_filter(senses, lambda s: len(s.glosses) > 0 AND NOT coalesce(list_has_any(s.tags, ['form-of', 'alt-of', 'obsolete']), false)), lambda s: s.glosses[-1])[:8] AS gl FROM dump WHERE pos NOT IN ({_lit(X.SKIP_VI_POS)})),
ex AS (SELECT place, word, pos, unnest(gl) AS gloss, generate_subscripts(gl, 1) - 1 AS ord FROM sn),
ch AS (SELECT *, CASE WHEN lag(pos) OVER w IS NOT DISTINCT FROM pos AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM ex WINDOW w AS (PARTITION BY word ORDER BY place, ord)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY word ORDER BY place, ord ROWS UNBOUNDED PRECEDING) AS run FROM ch),
lk AS (SELECT unnest(list_distinct([lower(p_name), lower(p_type)])) AS vi, a FROM p)
SELECT 'block' AS part, word, pos, array_to_string(flatten(list(gl ORDER BY place)), '; ') AS what FROM al WHERE len(gl) > 0 GROUP BY word, pos
UNION ALL SELECT 'sense', word, pos, place || ':' || ord || ':' || gloss FROM ex
UNION ALL SELECT 'run', word, pos, run || ':' || string_agg(gloss, '; ' ORDER BY place, ord) FROM rn GROUP BY word, run, pos
UNION ALL SELECT 'link', vi, 'noun', count(*) || ':2:' || max(a) || ':wiktionary' FROM lk GROUP BY vi
"""

QUERIES = {
    "english_entries": (english_entries, ENTRIES_SQL),
    "form_links": (form_links, LINKS_SQL),
    "word_relations": (word_relations, RELATIONS_SQL),
    "source_statistics": (source_statistics, STATISTICS_SQL),
    "enriched_entries": (enriched, ENRICHED_SQL),
    "frequency_list": (frequency_list, FREQUENCY_SQL),
    "source_senses": (source_senses, SOURCE_SQL),
    "prompt_texts": (prompts, PROMPTS_SQL),
    "validated_results": (validated, VALIDATED_SQL),
    "vietnamese_layer": (vietnamese, VIETNAMESE_SQL),
}
