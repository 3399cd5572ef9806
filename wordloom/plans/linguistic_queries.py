"""Queries over dependency tokens.

No parse is at hand, so each clean sentence's words become tokens by rule: a word's place and length give its part of speech,
tag, dependency and head.  The operators then do on them what they do on a real parse, and the twins say it in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import corpus as C
from wordloom.operators import linguistic as L
from wordloom.operators import reports as P
from wordloom.operators import tagger
from wordloom.operators.tables import cut
from wordloom.plans.corpus_queries import WITH, docs

#: By (place + length) modulo 12: part of speech, tag and dependency; the head is the word before or after.
_RULE = [
    ("NOUN", "NN", "nsubj", 1), ("VERB", "VBD", "ROOT", 0), ("ADP", "IN", "prep", -1), ("NOUN", "NNS", "pobj", -1), ("ADJ", "JJR", "amod", 1), ("NOUN", "NN", "compound", 1),
    ("VERB", "VBG", "pcomp", -1), ("ADV", "RBS", "advmod", 1), ("PART", "RP", "prt", -1), ("NOUN", "NN", "dobj", -1), ("ADJ", "JJ", "acomp", -1), ("ADP", "IN", "prep", -1),
]


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """All clean sentences as rows of their TOKENs."""
    s = C.clean_sentences(docs(spark, d)).select((F.col("doc_id") * 100000 + F.col("place")).alias("sent_id"), T.tokens("sentence").alias("ws"))

    def token(text: Column, i: Column) -> Column:
        at = (i + F.length(text)) % len(_RULE) + 1
        pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in _RULE]), at)
        head = F.greatest(F.lit(0), F.least(i + pick(3), F.size("ws") - 1))
        person = F.when(F.length(text) == 9, "PERSON").otherwise("")
        own = {"i": i, "text": text, "lemma": text, "pos": pick(0), "tag": pick(1), "dep": pick(2), "head": head, "is_alpha": F.lit(True), "is_stop": F.length(text) <= 2, "ent_type": person, "char_start": F.lit(0)}
        return F.struct(*[c.alias(n) for n, c in own.items()])

    return s.select("sent_id", F.transform("ws", token).alias("ts"))


def _list(k: int) -> str:
    return "[" + ", ".join(f"'{r[k]}'" if isinstance(r[k], str) else str(r[k]) for r in _RULE) + "]"


TOKENS = WITH + f"""
, w AS (SELECT doc_id * 100000 + place AS sent_id, regexp_extract_all(lower(sentence), '[a-z][a-z'']*') AS ws FROM clean),
u AS (SELECT sent_id, len(ws) AS size, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS i FROM w),
r AS (SELECT *, (i + length(text)) % {len(_RULE)} + 1 AS rr FROM u),
tok AS MATERIALIZED (
  SELECT sent_id, i, text, {_list(0)}[rr] AS pos, {_list(1)}[rr] AS tag, {_list(2)}[rr] AS dep, greatest(0, least(i + {_list(3)}[rr], size - 1)) AS head,
    length(text) <= 2 AS is_stop, length(text) = 9 AS person FROM r)
"""


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


PREPS = f"""
, prep AS (SELECT sent_id, head AS i, i AS prep_i, text AS prep FROM tok WHERE dep IN ('prep', 'dative') AND pos IN ('ADP', 'SCONJ') AND text NOT IN {_in(L.COMPARING)})
"""
#: In these tokens no subtree of a clause holds a question word but its own root, as roots of clauses have no such tags.
OBJ = PREPS + f"""
, kid AS (SELECT t.*, row_number() OVER (PARTITION BY t.sent_id, t.head ORDER BY t.i) AS k FROM tok t WHERE dep IN ('pobj', 'pcomp') AND (sent_id, head) IN (SELECT (sent_id, prep_i) FROM prep)),
obj AS (
  SELECT sent_id, head AS prep_i, CASE WHEN tag = 'VBG' THEN 'doing sth' WHEN text IN {_in(L.WH)} THEN 'wh-' WHEN text IN {_in(L.PEOPLE)} OR person THEN 'sb' WHEN pos <> 'PROPN' THEN 'sth' END AS obj FROM kid WHERE k = 1)
"""


def heads(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-24: how often each dependency joins two parts of speech, with the head before or after."""
    t = L.with_head(tokens(spark, d))
    return t.groupBy("dep", "pos", "h_pos", (F.col("i") < F.col("h_i")).alias("before")).agg(F.count("*").alias("n"))


HEADS_SQL = TOKENS + "SELECT a.dep, a.pos, b.pos AS h_pos, a.i < b.i AS before, count(*) AS n FROM tok a JOIN tok b ON a.sent_id = b.sent_id AND a.head = b.i GROUP BY ALL"


def prepositions(spark: SparkSession, d: str) -> DataFrame:
    """LNG-02: each preposition with the word that it belongs to."""
    return L.prepositions(tokens(spark, d)).groupBy("prep").agg(F.count("*").alias("n"), F.sum("i").alias("places"))


PREP_SQL = TOKENS + PREPS + "SELECT prep, count(*) AS n, sum(i)::BIGINT AS places FROM prep GROUP BY prep"


def complements(spark: SparkSession, d: str) -> DataFrame:
    """LNG-03: what follows each preposition."""
    return L.complement_types(tokens(spark, d)).select("sent_id", "prep_i", "obj")


COMPLEMENT_SQL = TOKENS + OBJ + "SELECT sent_id, prep_i::INT AS prep_i, obj FROM obj"


def deep_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens as trees: each word's head is one to three words before it, the first word is the root; words of three letters are question words."""

    def deep(t: Column) -> Column:
        head = F.greatest(F.lit(0), t["i"] - 1 - F.length(t["text"]) % 3)
        return t.withField("head", head).withField("tag", F.when(F.length(t["text"]) == 3, "WRB").otherwise(t["tag"]))

    return tokens(spark, d).withColumn("ts", F.transform("ts", deep))


DEEP = TOKENS + """
, deep AS (SELECT sent_id, i, text, dep, pos, person, greatest(0, i - 1 - length(text) % 3) AS head, CASE WHEN length(text) = 3 THEN 'WRB' ELSE tag END AS tag FROM
  (SELECT *, ['NN', 'VBD', 'IN', 'NNS', 'JJR', 'NN', 'VBG', 'RBS', 'RP', 'NN', 'JJ', 'IN'][(i + length(text)) % 12 + 1] AS tag FROM tok))
"""


def clause_sizes(spark: SparkSession, d: str) -> DataFrame:
    """LNG-03, JOIN-17: how many words are below each word of ten letters or more, at any depth, and the last of them."""
    found = L.subtrees(deep_tokens(spark, d), lambda t: F.length(t["text"]) >= 10)
    return found.groupBy("sent_id", "root").agg(F.count("*").alias("n"), F.max("i").alias("last"))


CLAUSE_SQL = DEEP.replace("WITH ", "WITH RECURSIVE ", 1) + """
, reach(sent_id, root, i) AS (
  SELECT sent_id, i, i FROM deep WHERE length(text) >= 10 UNION SELECT r.sent_id, r.root, t.i FROM reach r JOIN deep t ON t.sent_id = r.sent_id AND t.head = r.i AND t.i <> t.head)
SELECT sent_id, root, count(*) AS n, max(i) AS last FROM reach GROUP BY sent_id, root
"""


def clause_questions(spark: SparkSession, d: str) -> DataFrame:
    """LNG-03: what follows each preposition where a question word anywhere below a clause's verb decides."""
    clause = lambda t: t.withField("dep", F.when((t["dep"] == "pobj") & (t["i"] % 2 == 0), "pcomp").otherwise(t["dep"]))
    t = deep_tokens(spark, d).withColumn("ts", F.transform("ts", clause))
    return L.complement_types(t).groupBy("obj").agg(F.count("*").alias("n"), F.sum(F.col("prep_i").cast("bigint")).alias("places"))


QUESTION_SQL = DEEP.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, t AS (SELECT * REPLACE (CASE WHEN dep = 'pobj' AND i % 2 = 0 THEN 'pcomp' ELSE dep END AS dep) FROM deep),
prep AS (SELECT sent_id, i AS prep_i FROM t WHERE dep IN ('prep', 'dative') AND pos IN ('ADP', 'SCONJ') AND text NOT IN {_in(L.COMPARING)}),
kid AS (SELECT t.*, row_number() OVER (PARTITION BY t.sent_id, t.head ORDER BY t.i) AS k FROM t WHERE dep IN ('pobj', 'pcomp') AND (sent_id, head) IN (SELECT (sent_id, prep_i) FROM prep)),
reach(sent_id, root, i) AS (
  SELECT sent_id, i, i FROM kid WHERE k = 1 AND dep = 'pcomp' AND tag <> 'VBG' UNION SELECT r.sent_id, r.root, t.i FROM reach r JOIN t ON t.sent_id = r.sent_id AND t.head = r.i AND t.i <> t.head),
asks AS (SELECT DISTINCT r.sent_id, r.root AS i FROM reach r JOIN t USING (sent_id, i) WHERE t.tag IN ('WDT', 'WP', 'WRB') OR t.text = 'whether'),
obj AS (
  SELECT head AS prep_i, CASE WHEN tag = 'VBG' THEN 'doing sth' WHEN a.i IS NOT NULL OR text IN {_in(L.WH)} THEN 'wh-' WHEN text IN {_in(L.PEOPLE)} OR person THEN 'sb' WHEN pos <> 'PROPN' THEN 'sth' END AS obj
  FROM kid LEFT JOIN asks a ON a.sent_id = kid.sent_id AND a.i = kid.i WHERE k = 1)
SELECT obj, count(*) AS n, sum(prep_i)::BIGINT AS places FROM obj GROUP BY obj
"""


def tagged_tokens(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """TOKEN rows, or the named columns of them, of all clean sentences by a tagger that is fitted to them."""
    s = cut(C.clean_sentences(docs(spark, d)).select((F.col("doc_id") * 100000 + F.col("place")).alias("sent_id"), "sentence"))
    return tagger.annotate(s, tagger.fit(s), list(names) or None)


def tagged_words(spark: SparkSession, d: str) -> DataFrame:
    """LNG-01: how often each word has each part of speech."""
    return tagged_tokens(spark, d, "text", "pos").groupBy(F.col("text").alias("word"), "pos").agg(F.count("*").alias("n"))


def tagged_closed(spark: SparkSession, d: str) -> DataFrame:
    """LNG-01: words of closed classes: how often each is there, and whether it always is of a class that lists it."""
    lists = F.create_map(*[F.lit(x) for k, ws in tagger.CLOSED.items() for x in (k, f" {ws} ")])
    t = tagged_tokens(spark, d, "text", "pos", "is_stop").where("is_stop")
    tied = F.coalesce(lists[F.col("pos")].contains(F.concat(F.lit(" "), "text", F.lit(" "))), F.lit(False))
    return t.groupBy(F.col("text").alias("word")).agg(F.count("*").alias("n"), F.bool_and(tied).alias("tied"))


CLOSED_SQL = WITH + f"SELECT word, n, true AS tied FROM counts WHERE word IN {_in(sorted({w for ws in tagger.CLOSED.values() for w in ws.split()}))}"


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """LNG-04, FLT-25: strings of two prepositions or more, how often each is there and whether it would be shown."""
    seq = L.prep_sequences(tokens(spark, d)).groupBy("seq").agg((20 * F.count("*")).alias("n"))
    return seq.join(C.shown_sequences(seq).select("seq", F.lit(True).alias("shown")), "seq", "left").withColumn("shown", F.coalesce("shown", F.lit(False)))


SEQUENCE_SQL = TOKENS + OBJ + f"""
, p AS (SELECT p.sent_id, p.i, p.prep_i, p.prep, concat_ws(' ', p.prep, CASE WHEN obj = 'doing sth' THEN 'doing' ELSE obj END) AS part FROM prep p LEFT JOIN obj o ON o.sent_id = p.sent_id AND o.prep_i = p.prep_i),
s AS (SELECT sent_id, i, string_agg(part, ' ' ORDER BY prep_i) AS seq FROM p GROUP BY ALL HAVING count(DISTINCT prep) >= 2),
c AS (SELECT seq, 20 * count(*) AS n, string_split(seq, ' ') AS x FROM s GROUP BY seq),
f AS (SELECT seq, n, list_filter(x, lambda y: y IN ('sb', 'sth', 'wh-')) AS o, list_filter(x, lambda y: y NOT IN ('sb', 'sth', 'wh-', 'doing')) AS q FROM c)
SELECT seq, n, n >= 20 AND len(o) >= len(q) AND len(list_filter(q[2:], lambda y: y IN {_in(C.ADVERBIAL)})) = 0 AS shown FROM f
"""


def verb_phrases(spark: SparkSession, d: str) -> DataFrame:
    """LNG-07: verbs with their particles, counted."""
    return L.verb_phrases(tokens(spark, d)).groupBy("phrase").agg(F.count("*").alias("n"))


VERB_SQL = TOKENS + """
, prt AS (SELECT sent_id, head AS i, string_agg(text, ' ' ORDER BY i) AS particles FROM tok WHERE dep = 'prt' GROUP BY ALL)
SELECT concat_ws(' ', text, particles) AS phrase, count(*) AS n FROM tok LEFT JOIN prt USING (sent_id, i) WHERE pos = 'VERB' GROUP BY 1
"""


def collocations(spark: SparkSession, d: str) -> DataFrame:
    """LNG-05, FLT-26: the twelve patterns, counted by lemma and display."""
    return L.collocations(tokens(spark, d)).groupBy("lemma", "pos", "pattern", "display", "colloc").agg(F.count("*").alias("n"))


_GOOD = f"{{0}}pos NOT IN ('PROPN', 'PRON', 'NUM') AND {{0}}text NOT IN {_in(L.NO_COLLOCATE)} AND ({{0}}pos = 'VERB' OR NOT {{0}}is_stop)"
COLLOCATION_CTE = f"""
, pair AS (SELECT a.sent_id, a.i, a.text, a.pos, a.dep, b.i AS h_i, b.text AS h_text, b.pos AS h_pos, b.dep AS h_dep, b.head AS h_head, {_GOOD.format('a.')} AS c_ok, {_GOOD.format('b.')} AS h_ok
  FROM tok a JOIN tok b ON a.sent_id = b.sent_id AND a.head = b.i),
prt AS (SELECT sent_id, head AS i, string_agg(text, ' ' ORDER BY i) AS particles FROM tok WHERE dep = 'prt' GROUP BY ALL),
coll AS (
  SELECT sent_id, h_text AS lemma, h_pos AS pos, 'adj_w' AS pattern, text AS display, text AS colloc FROM pair WHERE h_pos = 'NOUN' AND dep = 'amod' AND pos = 'ADJ' AND i < h_i AND c_ok
  UNION ALL SELECT sent_id, h_text, h_pos, 'noun_noun', text || ' ' || h_text, text FROM pair WHERE h_pos = 'NOUN' AND dep = 'compound' AND pos = 'NOUN' AND c_ok
  UNION ALL SELECT sent_id, text, pos, 'noun_noun', text || ' ' || h_text, h_text FROM pair WHERE h_pos = 'NOUN' AND dep = 'compound' AND pos = 'NOUN' AND h_ok
  UNION ALL SELECT p.sent_id, text, pos, 'verb_w', concat_ws(' ', h_text, particles), h_text FROM pair p LEFT JOIN prt ON prt.sent_id = p.sent_id AND prt.i = p.h_i
    WHERE pos = 'NOUN' AND h_pos = 'VERB' AND ((dep IN ('dobj', 'nsubjpass') AND h_ok) OR (dep = 'dobj' AND h_text IN ('do', 'have')))
  UNION ALL SELECT sent_id, text, pos, 'w_verb', h_text, h_text FROM pair WHERE pos = 'NOUN' AND dep = 'nsubj' AND h_pos = 'VERB' AND h_ok
  UNION ALL SELECT p.sent_id, p.text, p.pos, 'quant_of_w', CASE WHEN regexp_matches(g.text, '^[aeiou]') THEN 'an ' ELSE 'a ' END || g.text || ' of', g.text FROM pair p JOIN tok g ON g.sent_id = p.sent_id AND g.i = p.h_head
    WHERE p.pos = 'NOUN' AND p.dep = 'pobj' AND p.h_dep = 'prep' AND p.h_text = 'of' AND g.text IN {_in(L.QUANTITIES)}
  UNION ALL SELECT sent_id, h_text, h_pos, 'w_noun', text, text FROM pair WHERE h_pos = 'VERB' AND dep IN ('dobj', 'nsubjpass') AND pos = 'NOUN' AND c_ok
  UNION ALL SELECT sent_id, h_text, h_pos, 'adv_w', text, text FROM pair WHERE h_pos IN ('VERB', 'ADJ') AND dep = 'advmod' AND pos = 'ADV' AND c_ok
  UNION ALL SELECT sent_id, text, pos, 'w_noun', h_text, h_text FROM pair WHERE pos = 'ADJ' AND dep = 'amod' AND h_pos = 'NOUN' AND i < h_i AND h_ok
  UNION ALL SELECT sent_id, text, pos, 'verb_w', h_text, h_text FROM pair WHERE pos = 'ADJ' AND dep IN ('acomp', 'oprd') AND h_pos IN ('VERB', 'AUX') AND h_text <> 'be' AND h_ok
  UNION ALL SELECT sent_id, text, pos, 'verb_w', h_text, h_text FROM pair WHERE pos = 'ADV' AND dep = 'advmod' AND h_pos = 'VERB' AND h_ok
  UNION ALL SELECT sent_id, text, pos, 'w_adj', h_text, h_text FROM pair WHERE pos = 'ADV' AND dep = 'advmod' AND h_pos IN ('ADJ', 'ADV') AND i < h_i AND h_ok)
"""
COLLOCATION_SQL = TOKENS + COLLOCATION_CTE + "SELECT lemma, pos, pattern, display, colloc, count(*) AS n FROM coll GROUP BY ALL"


def promoted(spark: SparkSession, d: str) -> DataFrame:
    """WIN-04 on the library's own collocations: do and have lead a noun's verbs where none is more frequent."""
    counts = L.collocations(tokens(spark, d)).groupBy("lemma", "pos", "pattern", "display", "colloc").agg(F.count("*").alias("n"))
    rows = counts.withColumn("logdice", F.round(F.lit(14) - F.log2(1 + F.length("colloc") + F.col("n")), 6))
    return C.ranked_collocations(rows, 5).select("lemma", "pos", "pattern", "display", "n", "rank")


PROMOTED_SQL = TOKENS + COLLOCATION_CTE + f"""
, c AS (SELECT lemma, pos, pattern, display, colloc, count(*) AS n FROM coll GROUP BY ALL),
n AS (SELECT *, round(14 - log2(1 + length(colloc) + n), 6) AS ld FROM c),
m AS (SELECT *, max(n) OVER (PARTITION BY lemma, pos, pattern) AS most FROM n)
SELECT lemma, pos, pattern, display, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lemma, pos, pattern ORDER BY (pos = 'NOUN' AND pattern = 'verb_w' AND colloc IN {_in(C.LIGHT_VERBS)} AND n = most) DESC, ld DESC, n DESC, display) AS rank FROM m) WHERE rank <= 5
"""


def roles(spark: SparkSession, d: str) -> DataFrame:
    """LNG-06, LNG-09: roles of words by lemma."""
    return L.roles(tokens(spark, d)).groupBy("lemma", "pos", "role").agg(F.count("*").alias("n"))


_FORM = "CASE tag " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in L.VERB_FORMS.items()) + " ELSE tag END"
ROLE_SQL = TOKENS + f"""
, k AS (SELECT sent_id, head AS i, bool_or(dep IN ('auxpass', 'nsubjpass')) AS passive, bool_or(text IN ('more', 'less')) AS more, bool_or(text IN ('most', 'least')) AS most FROM tok WHERE head <> i GROUP BY ALL),
e AS (SELECT sent_id, min(i) AS a, max(i) AS z FROM tok GROUP BY 1),
t AS (
  SELECT t.*, h.pos AS h_pos, h.text AS h_text, h.i AS h_i, coalesce(passive, false) AS passive, coalesce(more, false) AS more, coalesce(most, false) AS most, a, z
  FROM tok t JOIN tok h ON h.sent_id = t.sent_id AND h.i = t.head LEFT JOIN k ON k.sent_id = t.sent_id AND k.i = t.i JOIN e ON e.sent_id = t.sent_id),
rl AS (
  SELECT text AS lemma, pos, CASE WHEN dep IN ('nsubj', 'nsubjpass') THEN 'subject' WHEN dep = 'dobj' THEN 'object' WHEN dep = 'pobj' THEN 'after_prep' WHEN dep = 'compound' THEN 'noun_mod' WHEN dep = 'attr' THEN 'complement' END AS role FROM t WHERE pos = 'NOUN'
  UNION ALL SELECT text, pos, 'plural' FROM t WHERE pos = 'NOUN' AND tag = 'NNS'
  UNION ALL SELECT text, pos, {_FORM} FROM t WHERE pos = 'VERB'
  UNION ALL SELECT text, pos, 'passive' FROM t WHERE pos = 'VERB' AND passive
  UNION ALL SELECT text, pos, 'ing_subject' FROM t WHERE pos = 'VERB' AND tag = 'VBG' AND dep IN ('csubj', 'nsubj')
  UNION ALL SELECT text, pos, 'ing_after_prep' FROM t WHERE pos = 'VERB' AND tag = 'VBG' AND dep = 'pcomp'
  UNION ALL SELECT text, pos, CASE WHEN dep = 'amod' THEN CASE WHEN i < h_i THEN 'attributive' ELSE 'postnominal' END WHEN dep IN ('acomp', 'attr') OR h_text IN {_in(L.LINKING)} THEN 'predicative' END FROM t WHERE pos = 'ADJ'
  UNION ALL SELECT text, pos, CASE WHEN i = a THEN 'initial' WHEN i >= z THEN 'final' WHEN h_pos IN ('ADJ', 'ADV') AND i < h_i THEN 'before_adj' WHEN h_pos IN ('VERB', 'AUX') AND i < h_i THEN 'mid_before' ELSE 'mid_after' END FROM t WHERE pos = 'ADV'
  UNION ALL SELECT text, pos, 'comparative' FROM t WHERE (pos = 'ADJ' AND (tag = 'JJR' OR more)) OR (pos = 'ADV' AND (tag = 'RBR' OR more))
  UNION ALL SELECT text, pos, 'superlative' FROM t WHERE (pos = 'ADJ' AND (tag = 'JJS' OR most)) OR (pos = 'ADV' AND (tag = 'RBS' OR most)))
SELECT lemma, pos, role, count(*) AS n FROM rl WHERE role IS NOT NULL GROUP BY ALL
"""


def background(spark: SparkSession, d: str) -> DataFrame:
    """AGG-27, LNG-10: for each part of speech its tokens, those with a preposition, and its lemmas."""
    lemmas, rates = P.background(tokens(spark, d))
    return rates.join(lemmas.groupBy("pos").agg(F.count("*").alias("lemmas"), F.max("n").alias("most")), "pos")


BACKGROUND_SQL = TOKENS + PREPS + """
, h AS (SELECT DISTINCT sent_id, i FROM prep), l AS (SELECT text, pos, count(*) AS n FROM tok GROUP BY ALL),
bg AS (SELECT t.pos, count(*) AS n, count(h.i) AS with_prep FROM tok t LEFT JOIN h ON h.sent_id = t.sent_id AND h.i = t.i GROUP BY 1)
SELECT pos, bg.n, with_prep, lemmas, most FROM bg JOIN (SELECT pos, count(*) AS lemmas, max(n) AS most FROM l GROUP BY 1) USING (pos)
"""


def passing(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-19: strings of prepositions with one that is frequent after its word."""
    t = tokens(spark, d)
    seq = L.prep_sequences(t, "lemma", "pos").where("lemma IS NOT NULL").groupBy("lemma", "pos", "seq").agg((5 * F.count("*")).alias("n"))
    patterns = L.prepositions(L.with_head(t), "h_lemma", "h_pos").groupBy(F.col("h_lemma").alias("lemma"), F.col("h_pos").alias("pos"), "prep").agg((F.count("*") >= 3).alias("pass"))
    return C.passing_sequences(seq, patterns)


PASSING_SQL = TOKENS + OBJ + """
, p AS (SELECT p.sent_id, p.i, p.prep_i, p.prep, concat_ws(' ', p.prep, CASE WHEN obj = 'doing sth' THEN 'doing' ELSE obj END) AS part FROM prep p LEFT JOIN obj o ON o.sent_id = p.sent_id AND o.prep_i = p.prep_i),
s AS (SELECT sent_id, i, string_agg(part, ' ' ORDER BY prep_i) AS seq FROM p GROUP BY ALL HAVING count(DISTINCT prep) >= 2),
n AS (SELECT text AS lemma, pos, seq, 5 * count(*) AS n FROM s JOIN tok USING (sent_id, i) GROUP BY ALL),
g AS (SELECT text AS lemma, pos, prep FROM prep JOIN tok USING (sent_id, i) GROUP BY ALL HAVING count(*) >= 3),
x AS (SELECT *, unnest(string_split(seq, ' ')) AS prep FROM n)
SELECT DISTINCT lemma, pos, seq, n FROM x JOIN g USING (lemma, pos, prep) WHERE prep NOT IN ('sb', 'sth', 'doing', 'wh-')
"""

QUERIES = {
    "token_heads": (heads, HEADS_SQL),
    "prepositions": (prepositions, PREP_SQL),
    "complement_types": (complements, COMPLEMENT_SQL),
    "tagged_words": (tagged_words, None),
    "tagged_closed": (tagged_closed, CLOSED_SQL),
    "clause_sizes": (clause_sizes, CLAUSE_SQL),
    "clause_questions": (clause_questions, QUESTION_SQL),
    "prep_sequences": (sequences, SEQUENCE_SQL),
    "passing_sequences": (passing, PASSING_SQL),
    "verb_phrases": (verb_phrases, VERB_SQL),
    "token_collocations": (collocations, COLLOCATION_SQL),
    "promoted_collocations": (promoted, PROMOTED_SQL),
    "token_roles": (roles, ROLE_SQL),
    "token_background": (background, BACKGROUND_SQL),
}
