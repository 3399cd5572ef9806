"""Queries of text functions over words, pages and documents, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.plans.corpus_queries import docs, table


def words(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct run of letters of the documents."""
    return docs(spark, d).select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where("word <> ''").distinct()


WORDS = r"w AS (SELECT * FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS word FROM documents) WHERE word <> '')"


def phonetics(spark: SparkSession, d: str) -> DataFrame:
    """STR-14..16: words dressed up as old and new transcriptions, cleaned and recoded."""
    w = words(spark, d)
    n = F.length("word")
    dressed = F.when(n % 4 == 0, F.concat(F.lit("/'"), "word", F.lit("'ɹa ~ x/"))).when(n % 4 == 1, F.concat(F.lit("/"), "word", F.lit(" ˌ e -ly/"))).when(n % 4 == 2, F.concat(F.lit("ˈ"), "word", F.lit(" [u]"))).otherwise("")
    old = F.when(n % 3 == 0, F.concat("word", F.lit("'ʤ^i:; b"))).when(n % 3 == 1, F.concat(F.lit("/"), "word", F.lit("ə:, -s/"))).otherwise(F.concat(F.lit("["), "word", F.lit("]e")))
    return w.select("word", T.ipa_clean(dressed).alias("clean"), T.old_phonetic_to_ipa(F.lower(old)).alias("ipa"))


_V = "aeiouæɑɒɔəɛɜɪʊʌɚɝɐɵ"
PHONETIC_SQL = f"""
WITH {WORDS},
c AS (
  SELECT word, length(word) AS n, translate(CASE length(word) % 4 WHEN 0 THEN '/''' || word || '''ɹa ~ x/' WHEN 1 THEN '/' || word || ' ˌ e -ly/' WHEN 2 THEN 'ˈ' || word || ' [u]' ELSE '' END, 'ɹ'':', 'rˈː') AS s,
    lower(CASE length(word) % 3 WHEN 0 THEN word || '''ʤ^i:; b' WHEN 1 THEN '/' || word || 'ə:, -s/' ELSE '[' || word || ']e' END) AS o FROM w),
d AS (SELECT *, CASE n % 4 WHEN 0 THEN '/ˈ' || word || 'ˈra' WHEN 1 THEN '/' || word WHEN 2 THEN 'ˈ' || word ELSE '' END AS t FROM c),
e AS (SELECT *, CASE n % 4 WHEN 0 THEN '/ˌ' || word || 'ˈra/' WHEN 1 THEN '/' || word || '/' ELSE t END AS clean FROM d),
f AS (SELECT *, translate(CASE n % 3 WHEN 0 THEN lower(word) || '''ʤ^i:' WHEN 1 THEN lower(word) || 'ə:' ELSE lower(word) || 'e' END, 'әєεˊ'':^g', 'əɛɛˈˈːɡɡ') AS p FROM e),
g AS (SELECT *, replace(replace(regexp_replace(regexp_replace(replace(p, 'ʤ', 'dʒ'), 'j([{_V}j])', chr(1) || '\\1', 'g'), 'j([{_V}j])', chr(1) || '\\1', 'g'), 'j', 'ʊ'), chr(1), 'j') AS q FROM f),
h AS (SELECT word, clean, replace(replace(q, 'əː', 'ɜː'), 'ɒː', 'ɔː') AS q FROM g)
SELECT word, clean, CASE WHEN regexp_matches(q, '^[abdefhijklmnprstuvwxzæɑɒɔəɛɜɪʊʌŋθðʃʒɡɚɝɐɵˈˌː()\\- ]+$') AND regexp_matches(q, '[{_V}]') THEN '/' || q || '/' END AS ipa FROM h
"""


def word_forms(spark: SparkSession, d: str) -> DataFrame:
    """STR-01, STR-12, STR-13, STR-23, VAR-18, VAR-35, SNK-19: each word's foldings, counts and fields."""
    return words(spark, d).select(
        "word", T.fold_keep_d("word").alias("kept"), T.count_overlapping(F.lower("word"), "an").alias("an"), T.recode(F.lower("word"), T.POS_ALIASES).alias("recoded"), T.recode("word", T.GUIDEWORD_FIXES).alias("fixed"),
        T.empty_to_null(F.substring("word", 2, 1)).alias("second"), T.csv_field(F.concat("word", F.substring(F.lit(',x"'), 1, F.length("word") % 4))).alias("field"),
    )


FORMS_SQL = f"""
WITH {WORDS}
SELECT word, strip_accents(lower(word)) AS kept, len(list_filter(range(1, length(word)), lambda i: substr(lower(word), i, 2) = 'an'))::INT AS an,
  CASE lower(word) WHEN 'adjective' THEN 'adj' WHEN 'adverb' THEN 'adv' WHEN 'preposition' THEN 'prep' WHEN 'conjunction' THEN 'conj' WHEN 'pronoun' THEN 'pron' WHEN 'interjection' THEN 'intj' WHEN 'determiner' THEN 'det' WHEN 'numeral' THEN 'num' ELSE lower(word) END AS recoded,
  word AS fixed, nullif(substr(word, 2, 1), '') AS second,
  CASE length(word) % 4 WHEN 0 THEN word WHEN 3 THEN '"' || word || ',x' || repeat('"', 3) ELSE '"' || word || substr(',x', 1, length(word) % 4) || '"' END AS field FROM w
"""


def typed_queries(spark: SparkSession, d: str) -> DataFrame:
    """FLT-29, FLT-30, STR-39, STR-34, VAR-49: conversations' turns as typed queries: cleaned, shortened, as names and as shared text."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.clean_query("text").alias("clean"), T.shorten_query("text", 60).alias("short"), T.shared_text("text").alias("shared"), T.list_name("text").alias("name"))


_WS = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TYPED_SQL = rf"""
WITH c AS (SELECT *, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS t, list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{Nl}}''\-?*.\t\n\v\f\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'), '{_WS}+', ' ', 'g'), '^ | $', '', 'g') AS clean,
  CASE WHEN length(text) > 60 OR regexp_matches(text, '[.!?]\s') THEN array_to_string(w[:3], ' ') ELSE text END AS short, substr(regexp_replace(string_split(t, chr(10))[1], '{_WS}+$', ''), 1, 100) AS shared,
  CASE WHEN length(array_to_string(w, ' ')) BETWEEN 1 AND 80 THEN array_to_string(w, ' ') END AS name FROM c
"""


def sentence_marks(spark: SparkSession, d: str) -> DataFrame:
    """STR-26, FLT-21, STR-27, STR-28: whole-word hits of a line's first word, its forms marked, and a label by rules."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("w", F.regexp_extract("t", r"\p{L}+", 0)).where("w <> ''")
    marked = T.mark_forms(F.col("t"), F.array(F.lower("w"), F.lit("the")))
    tags = F.split(F.substring(F.lower("w"), 1, 3), "")
    return lines.select(
        "doc_id", "line", T.word_boundary_hit(F.col("t"), F.lower("w")).alias("lower_hit"), F.size(F.filter(marked, lambda x: x["hit"])).alias("hits"), F.size(marked).alias("words"),
        T.first_label(tags, [(["t", "h"], "th"), (["a"], "a"), (["e", "n"], "en")]).alias("label"),
    )


MARKS_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
m AS (SELECT *, regexp_extract(t, '\p{L}+') AS w, regexp_extract_all(t, '\p{L}[\p{L}\p{M}''’-]*') AS x, lower(substr(regexp_extract(t, '\p{L}+'), 1, 3)) AS h FROM l)
SELECT doc_id, line::INT AS line, list_contains(regexp_split_to_array(t, '[^\p{L}]+'), lower(w)) AS lower_hit, len(list_filter(x, lambda y: lower(y) IN (lower(w), 'the')))::INT AS hits, len(x)::INT AS words,
  CASE WHEN contains(h, 't') AND contains(h, 'h') THEN 'th' WHEN contains(h, 'a') THEN 'a' WHEN contains(h, 'e') AND contains(h, 'n') THEN 'en' END AS label FROM m WHERE w <> ''
"""


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """STR-36, STR-20, NST-04, FLT-24: JSON inside other text, kept lists, and the first prose lines of whole documents."""
    from wordloom.operators.nested import json_list
    from wordloom.operators.tables import conform

    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Sure:\n"), F.col("props"), F.lit("\nDone")).alias("answer"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "b"]'))).when(F.col("event_id") % 3 == 1, "not json").alias("kept"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("number"))
    checked = conform(e.select("event_id", "number"), "event_id bigint, number int, missing string")
    return e.select("event_id", T.json_inside("answer").alias("json"), F.array_join(json_list("kept"), "+").alias("kept")).join(checked, "event_id")


ANSWERS_SQL = """
SELECT event_id, props AS json, CASE WHEN event_id % 3 = 0 THEN event_type || '+b' ELSE '' END AS kept, CASE WHEN event_id % 2 = 1 THEN user_id::INT END AS number, NULL::VARCHAR AS missing FROM events
"""


def etymologies(spark: SparkSession, d: str) -> DataFrame:
    """STR-20: the first two prose lines of each document."""
    return docs(spark, d).select("doc_id", T.clean_etymology("text").alias("prose"))


ETYMOLOGY_SQL = rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(Etymology tree|[├└│].*)$')) AS x FROM documents)
SELECT doc_id, array_to_string(x[:2], ' ') AS prose FROM l
"""

QUERIES = {
    "phonetics": (phonetics, PHONETIC_SQL),
    "word_forms": (word_forms, FORMS_SQL),
    "typed_queries": (typed_queries, TYPED_SQL),
    "sentence_marks": (sentence_marks, MARKS_SQL),
    "model_answers": (model_answers, ANSWERS_SQL),
    "etymologies": (etymologies, ETYMOLOGY_SQL),
}
