"""Patterns over dependency-annotated tokens (LNG-*).

Input is the relation token(sent_id, i, text, lemma, pos, tag, dep, head, is_alpha, is_stop, ent_type); an annotator
writes it, see ``annotate``.  Operators also take sentences (sent_id and ts, a sentence's tokens by place), see ``packed``: a sentence is of bounded
size and nothing is joined beyond it, so heads and children meet inside its row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import ship

TOKEN = "sent_id bigint, i int, text string, lemma string, pos string, tag string, dep string, head int, is_alpha boolean, is_stop boolean, ent_type string, char_start int"
#: Words for people, prepositions of comparison, quantities, and lemmas that make no collocation.
PEOPLE = (
    "me you him her us them someone somebody anyone anybody everyone everybody nobody people person man woman men women child children parent friend "
    "teacher family student doctor who whom mother father boss government team customer other others parents husband wife son daughter brother sister "
    "colleague friends students teachers kids kid boy girl boys girls baby guest guests neighbour neighbor neighbours neighbors staff employee employees "
    "worker workers public audience user users patient patients client clients member members leader leaders partner partners relative relatives adult "
    "adults citizen citizens officer police king queen god himself herself themselves myself yourself ourselves"
).split()
COMPARING = ["than", "as"]
QUANTITIES = (
    "piece bit word item lot number couple deal amount series kind sort type range variety set pair sheet slice cup glass bottle loaf bar drop grain "
    "handful flash stroke gust burst fit round spell source lack wealth"
).split()
NO_COLLOCATE = "not so very too also just then only even still there here as how when why where more most be have do -PRON-".split()
WH = "what how whether who where when why".split()
LINKING = "be seem become feel look remain get".split()
#: Codes of verb forms by tag.
VERB_FORMS = {"VB": "base", "VBP": "present", "VBZ": "s_form", "VBD": "past", "VBG": "ing", "VBN": "pp"}


def annotate(sentences: DataFrame, start: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> DataFrame:
    """LNG-01: a pluggable annotator; ``start`` loads its model once a task and returns a function from texts to tokens."""
    import pandas as pd

    names = [x.split()[0] for x in TOKEN.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = start()
        for b in batches:
            rows = [{"sent_id": s, **t} for s, ts in zip(b["sent_id"], parse(list(b["sentence"]))) for t in ts]
            yield pd.DataFrame(rows, columns=names)

    return sentences.select("sent_id", "sentence").mapInPandas(run, TOKEN)


def packed(tokens: DataFrame) -> DataFrame:
    """sent_id and ts, a sentence's tokens by place: one shuffle, or none if they come so."""
    if "ts" in tokens.columns:
        return tokens
    return tokens.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("i", *[c for c in tokens.columns if c not in ("sent_id", "i")]))).alias("ts"))


def flat(tokens: DataFrame) -> DataFrame:
    """A row a token.

    Outer generators, whose empty rows then go: of others Spark infers a filter below them, which would work out their arrays twice.
    """
    return tokens.select("sent_id", F.inline_outer("ts")).where("i IS NOT NULL") if "ts" in tokens.columns else tokens


def _at(i: Column) -> Column:
    """The sentence's token with a place, null if there is none; places that leave none out are found at once."""
    near = F.get("ts", i - F.get("ts", F.lit(0))["i"])
    return F.when(near["i"] == i, near).otherwise(F.get(F.filter("ts", lambda t: t["i"] == i), F.lit(0)))


def _beside(t: Column) -> Column:
    return F.struct(t.alias("t"), _at(t["head"]).alias("h"))


def with_head(tokens: DataFrame, prefix: str = "h") -> DataFrame:
    """JOIN-24: each token beside its head."""
    s = packed(tokens)
    pairs = s.select("sent_id", F.explode_outer(F.transform("ts", _beside)).alias("p")).where("p.h IS NOT NULL")
    names = s.schema["ts"].dataType.elementType.names
    return pairs.select("sent_id", "p.t.*", F.col("sent_id").alias(f"{prefix}_sent_id"), *[F.col("p.h")[n].alias(f"{prefix}_{n}") for n in names])


def _is_prep(t) -> Column:
    return t["dep"].isin("prep", "dative") & t["pos"].isin("ADP", "SCONJ") & ~F.lower(t["text"]).isin(COMPARING)


def prepositions(tokens: DataFrame, *keep: str) -> DataFrame:
    """LNG-02: prepositions with the word that they belong to: sent_id, i, prep_i, prep, and columns that are kept."""
    c = flat(tokens).where(_is_prep({n: F.col(n) for n in ("dep", "pos", "text")}))
    return c.select("sent_id", F.col("head").alias("i"), F.col("i").alias("prep_i"), F.lower("text").alias("prep"), *keep)


def _parents(places: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences' tokens in one row: each one's sentence, place, and head as an index, -1 for none or itself."""
    size = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of, place, up = np.repeat(np.arange(len(size)), size), places.flatten().to_numpy(zero_copy_only=False).astype(np.int64), heads.flatten()
    known = pc.is_valid(up).to_numpy(zero_copy_only=False)
    head = pc.fill_null(up, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    key, wanted = (of << 33) + place, (of << 33) + head
    at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
    return of, place, np.where(known & (head != place) & (key[at] == wanted), at, -1) if len(key) else at


def _lists(of: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=n))].astype(np.int32)), values)


def _over(places: pa.Array, heads: pa.Array, marked: pa.Array) -> pa.Array:
    """Places of marked tokens and of all words that have one below them, at any depth; each word is met once, so cycles end."""
    of, place, parent = _parents(places, heads)
    done = pc.fill_null(marked.flatten(), False).to_numpy(zero_copy_only=False).astype(bool)
    some = np.flatnonzero(done)
    while len(some):
        up = parent[some]
        up = np.unique(up[up >= 0])
        some = up[~done[up]]
        done[some] = True
    return _lists(of[done], pa.array(place[done].astype(np.int32)), len(places))


def _under(places: pa.Array, heads: pa.Array, marked: pa.Array) -> pa.Array:
    """Each marked token with itself and all below it: tokens climb by one head a round, for as many rounds as their sentence has tokens."""
    of, place, parent = _parents(places, heads)
    root = pc.fill_null(marked.flatten(), False).to_numpy(zero_copy_only=False).astype(bool)
    size, node = np.bincount(of, minlength=len(places)), np.arange(len(of))
    at, found, rounds = node, [], 0
    while len(node):
        hit = root[at]
        found.append(node[hit] * len(of) + at[hit])
        rounds += 1
        at = parent[at]
        on = (at >= 0) & (rounds < size[of[node]])
        node, at = node[on], at[on]
    # Ways up that end in a cycle meet its words again.
    pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    low, top = np.divmod(pair, max(len(of), 1))
    values = pa.StructArray.from_arrays([pa.array(place[x].astype(np.int32)) for x in (top, low)], ["root", "i"])
    return _lists(of[low], values, len(places))


def _closure(over: Callable[..., pa.Array], kind: str, where: Column, marks: Callable[[Column], Column]) -> Column:
    """Only sentences with marks go to Python whole."""
    some = where & F.exists("ts", marks)
    return F.arrow_udf(over, kind)(F.when(some, F.col("ts")["i"]), F.when(some, F.col("ts")["head"]), F.when(some, F.transform("ts", marks)))


def subtrees(tokens: DataFrame, root: Callable[[Column], Column]) -> DataFrame:
    """sent_id, root, i: all tokens below each token that ``root`` tells of, itself included, however deep; cycles of heads end."""
    ship(tokens.sparkSession)
    found = _closure(_under, "array<struct<root:int,i:int>>", F.lit(True), root)
    return packed(tokens).select("sent_id", found.alias("found")).select("sent_id", F.inline_outer("found")).where("root IS NOT NULL")


def _is_question(t: Column) -> Column:
    return t["tag"].isin("WDT", "WP", "WRB") | (F.lower(t["text"]) == "whether")


def _has(places: str, i: Column) -> Column:
    """Whether a column of places has one.  Spark would move a column that is read once into the lambda and work it out for each element; read twice, it stays."""
    return (F.size(places) > 0) & F.array_contains(places, i)


def _complemented(tokens: DataFrame) -> DataFrame:
    """Sentences with os, their prepositions: i, prep_i, prep, led (whether a complement is there) and obj."""
    ship(tokens.sparkSession)
    kid = lambda p: F.get(F.filter("ts", lambda t: t["dep"].isin("pobj", "pcomp") & (t["head"] == p["i"])), F.lit(0))
    s = packed(tokens).withColumn("ks", F.transform(F.filter("ts", _is_prep), lambda p: F.struct(p.alias("p"), kid(p).alias("k"))))
    clause = lambda k: (k["dep"] == "pcomp") & (k["tag"] != "VBG")
    s = s.withColumn("asking", _closure(_over, "array<int>", F.exists("ks", lambda x: clause(x["k"])), _is_question))

    def kind(k: Column) -> Column:
        person = F.lower(k["text"]).isin(PEOPLE) | F.lower(k["lemma"]).isin(PEOPLE) | (k["ent_type"] == "PERSON")
        asks = clause(k) & _has("asking", k["i"])
        return F.when(k["tag"] == "VBG", "doing sth").when(asks | F.lower(k["text"]).isin(WH), "wh-").when(person, "sb").when(k["pos"] != "PROPN", "sth")

    each = lambda x: F.struct(x["p"]["head"].alias("i"), x["p"]["i"].alias("prep_i"), F.lower(x["p"]["text"]).alias("prep"), x["k"].isNotNull().alias("led"), kind(x["k"]).alias("obj"))
    return s.withColumn("os", F.transform("ks", each))


def complement_types(tokens: DataFrame) -> DataFrame:
    """LNG-03: what follows a preposition, sb, sth, doing sth or wh-: sent_id, prep_i, obj (null for a proper noun)."""
    return _complemented(tokens).select("sent_id", F.inline_outer("os")).where("led").select("sent_id", "prep_i", "obj")


def prep_sequences(tokens: DataFrame, *keep: str) -> DataFrame:
    """LNG-04: for words with two prepositions or more, the string of prepositions and complements in order: sent_id, i, seq, and fields of the word that are kept."""
    part = lambda o: F.concat_ws(" ", o["prep"], F.when(o["obj"] == "doing sth", "doing").otherwise(o["obj"]))

    def of(i: Column) -> Column:
        own = F.filter("os", lambda o: o["i"] == i)
        several = F.size(F.array_distinct(F.transform(own, lambda o: o["prep"]))) >= 2
        return F.struct(i.alias("i"), F.when(several, F.array_join(F.transform(own, part), " ")).alias("seq"), *([_at(i).alias("w")] if keep else []))

    found = _complemented(tokens).select("sent_id", F.inline_outer(F.transform(F.array_distinct(F.col("os")["i"]), of))).where("seq IS NOT NULL")
    return found.select("sent_id", "i", "seq", *[F.col("w")[c].alias(c) for c in keep])


def _collocates(p: str = "") -> Column:
    c = lambda n: F.col(p + n)
    return c("is_alpha") & ~c("pos").isin("PROPN", "PRON", "NUM") & ~F.lower(c("lemma")).isin(NO_COLLOCATE) & ((c("pos") == "VERB") | ~c("is_stop"))


def _phrase(t: Column) -> Column:
    """A verb's lemma and its particles, of sentences with prt."""
    own = F.transform(F.filter("prt", lambda k: k["head"] == t["i"]), lambda k: F.lower(k["text"]))
    return F.concat_ws(" ", F.lower(t["lemma"]), F.when(F.size("prt") > 0, own))


def _with_particles(tokens: DataFrame) -> DataFrame:
    return packed(tokens).select("sent_id", "ts", F.filter("ts", lambda t: t["dep"] == "prt").alias("prt"))


def verb_phrases(tokens: DataFrame) -> DataFrame:
    """LNG-07: a verb's lemma and its particles: sent_id, i, phrase."""
    verbs = F.filter("ts", lambda t: t["pos"] == "VERB")
    return _with_particles(tokens).select("sent_id", F.inline_outer(F.transform(verbs, lambda t: F.struct(t["i"].alias("i"), _phrase(t).alias("phrase"))))).where("i IS NOT NULL")


def collocations(tokens: DataFrame) -> DataFrame:
    """LNG-05, FLT-26: sent_id, i, lemma, pos, pattern, display, colloc: the twelve patterns, as codes; tokens are read once."""
    low = F.lower

    def more(p: Column) -> Column:
        t, h = p["t"], p["h"]
        quantity = (t["pos"] == "NOUN") & (t["dep"] == "pobj") & (h["dep"] == "prep") & (low(h["text"]) == "of")
        return F.struct(t.alias("t"), h.alias("h"), F.when((t["pos"] == "NOUN") & (h["pos"] == "VERB"), _phrase(h)).alias("phrase"), F.when(quantity, low(_at(h["head"])["lemma"])).alias("g_lemma"))

    # The token is the child, h_ its head; g_ the head of that.
    s = _with_particles(tokens)
    names = s.schema["ts"].dataType.elementType.names
    pairs = s.select("sent_id", F.explode_outer(F.transform(F.transform("ts", _beside), more)).alias("p")).where("p.h IS NOT NULL")
    pairs = pairs.select("sent_id", "p.t.*", *[F.col("p.h")[n].alias(f"h_{n}") for n in names], "p.phrase", "p.g_lemma")
    child, head = _collocates(), _collocates("h_")

    def of_child(where: Column, pattern: str, display: Column | None = None, colloc: Column | None = None) -> Column:
        """The pattern's word is the child, its collocate the head."""
        other = low("h_lemma") if colloc is None else colloc
        return F.when(where, F.struct(F.col("i"), low("lemma").alias("lemma"), F.col("pos"), F.lit(pattern).alias("pattern"), (other if display is None else display).alias("display"), other.alias("colloc")))

    def of_head(where: Column, pattern: str, display: Column | None = None) -> Column:
        return F.when(where, F.struct(F.col("h_i").alias("i"), low("h_lemma").alias("lemma"), F.col("h_pos").alias("pos"), F.lit(pattern).alias("pattern"), (low("lemma") if display is None else display).alias("display"), low("lemma").alias("colloc")))

    both = F.concat_ws(" ", low("lemma"), low("h_lemma"))
    pos, hpos, dep = F.col("pos"), F.col("h_pos"), F.col("dep")
    before = F.col("i") < F.col("h_i")
    light = (dep == "dobj") & low("h_lemma").isin("do", "have")
    verbs = of_child((pos == "NOUN") & (hpos == "VERB") & ((dep.isin("dobj", "nsubjpass") & head) | light), "verb_w", F.col("phrase"))
    article = F.when(F.col("g_lemma").rlike("^[aeiou]"), "an ").otherwise("a ")
    quantities = of_child(F.col("g_lemma").isin(QUANTITIES), "quant_of_w", F.concat(article, "g_lemma", F.lit(" of")), F.col("g_lemma"))
    parts = [
        of_head((hpos == "NOUN") & (dep == "amod") & (pos == "ADJ") & before & child, "adj_w"),
        of_head((hpos == "NOUN") & (dep == "compound") & (pos == "NOUN") & child, "noun_noun", both),
        of_child((pos == "NOUN") & (dep == "compound") & (hpos == "NOUN") & head, "noun_noun", both),
        verbs,
        of_child((pos == "NOUN") & (dep == "nsubj") & (hpos == "VERB") & head, "w_verb"),
        quantities,
        of_head((hpos == "VERB") & dep.isin("dobj", "nsubjpass") & (pos == "NOUN") & child, "w_noun"),
        of_head((hpos == "VERB") & (dep == "advmod") & (pos == "ADV") & child, "adv_w"),
        of_head((hpos == "ADJ") & (dep == "advmod") & (pos == "ADV") & child, "adv_w"),
        of_child((pos == "ADJ") & (dep == "amod") & (hpos == "NOUN") & before & head, "w_noun"),
        of_child((pos == "ADJ") & dep.isin("acomp", "oprd") & hpos.isin("VERB", "AUX") & (F.col("h_lemma") != "be") & head, "verb_w"),
        of_child((pos == "ADV") & (dep == "advmod") & (hpos == "VERB") & head, "verb_w"),
        of_child((pos == "ADV") & (dep == "advmod") & hpos.isin("ADJ", "ADV") & before & head, "w_adj"),
    ]
    return pairs.select("sent_id", F.inline_outer(F.array(*parts))).where("pattern IS NOT NULL")


def roles(tokens: DataFrame) -> DataFrame:
    """LNG-06, LNG-09: sent_id, i, lemma, pos, role; a token may have several roles."""
    with_kid = lambda cond: F.transform(F.filter("ts", lambda k: (k["head"] != k["i"]) & cond(k)), lambda k: k["head"])
    text = lambda *words: lambda k: F.lower(k["text"]).isin(*words)
    kids = {"k_passive": lambda k: k["dep"].isin("auxpass", "nsubjpass"), "k_to": lambda k: (k["dep"] == "aux") & (k["tag"] == "TO"), "k_more": text("more", "less"), "k_most": text("most", "least")}
    places = F.transform(F.filter("ts", lambda t: t["pos"] != "PUNCT"), lambda t: t["i"])
    s = packed(tokens).select("sent_id", "ts", F.array_min(places).alias("first_i"), F.array_max(places).alias("last_i"), *[with_kid(c).alias(n) for n, c in kids.items()])
    pair = lambda t: F.struct(t.alias("t"), _at(t["head"]).alias("h"), *[_has(n, t["i"]).alias(n) for n in kids])
    t = s.select("sent_id", "first_i", "last_i", F.explode_outer(F.transform("ts", pair)).alias("p")).where("p.h IS NOT NULL")
    t = t.select("sent_id", "first_i", "last_i", "p.t.*", *[F.col("p.h")[n].alias(f"h_{n}") for n in ("i", "pos", "lemma")], *[F.col("p")[n].alias(n) for n in kids])
    pos, dep, tag, before = F.col("pos"), F.col("dep"), F.col("tag"), F.col("i") < F.col("h_i")
    noun = [
        F.when(dep.isin("nsubj", "nsubjpass"), "subject").when(dep == "dobj", "object").when(dep == "pobj", "after_prep").when(dep == "compound", "noun_mod").when(dep == "attr", "complement"),
        F.when(tag == "NNS", "plural"),
    ]
    form = F.create_map(*[F.lit(x) for kv in VERB_FORMS.items() for x in kv])
    verb = [
        F.coalesce(form[tag], tag), F.when(F.col("k_passive"), "passive"), F.when(F.col("k_to"), "to_inf"), F.when((tag == "VBG") & dep.isin("csubj", "nsubj"), "ing_subject"), F.when((tag == "VBG") & (dep == "pcomp"), "ing_after_prep"),
    ]
    compared = lambda er, est: [F.when((tag == er) | F.col("k_more"), "comparative"), F.when((tag == est) | F.col("k_most"), "superlative")]
    adj = [F.when(dep == "amod", F.when(before, "attributive").otherwise("postnominal")).when(dep.isin("acomp", "attr") | F.col("h_lemma").isin(LINKING), "predicative"), *compared("JJR", "JJS")]
    adv = [
        F.when(F.col("i") == F.col("first_i"), "initial").when(F.col("i") >= F.col("last_i"), "final").when(F.col("h_pos").isin("ADJ", "ADV") & before, "before_adj").when(F.col("h_pos").isin("VERB", "AUX") & before, "mid_before").otherwise("mid_after"),
        *compared("RBR", "RBS"),
    ]
    found = F.when(pos == "NOUN", F.array(*noun)).when(pos == "VERB", F.array(*verb)).when(pos == "ADJ", F.array(*adj)).when(pos == "ADV", F.array(*adv))
    return t.select("sent_id", "i", F.lower("lemma").alias("lemma"), "pos", F.explode_outer(found).alias("role")).where("role IS NOT NULL")
