"""Corpus statistics over sentences: clean, fold, count, associate, select."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.relational import balanced_pick, first_by, global_rank, top_k
from wordloom.operators.tables import cut
from wordloom.session import ship

#: FLT-17 thresholds (count, ratio, lift), FLT-16 shares, AGG-03 limits.
PREP_MIN = {"NOUN": (8, 0.010, 2.0), "VERB": (8, 0.015, 2.5), "ADJ": (8, 0.015, 2.5), "ADV": (8, 0.02, 3.0)}
POS_SHARE_MIN, POS_SHARE_N = 0.05, 50
COLL_MIN_N, COLL_MIN_LD, COLL_TOP, COLL_SHOWN = 5, 3.0, 20, 12
SEQ_MIN_N = 5
LIGHT_VERBS = ("do", "have")
#: Words that open a sentence which leans on the one before.
OPENING_PRONOUNS = "he she it they this that these those him her them his its their".split()

#: Words that bar a sentence from the examples, and words that count against it.
BLOCKED = (
    "fuck fucking fucked shit bitch bastard cunt dick cock pussy asshole whore slut "
    "nigger faggot retard rape raped rapist porn pornography pornographic sex sexual "
    "sexually naked nude masturbate orgasm penis vagina erotic prostitute prostitution "
    "suicide behead beheaded torture tortured massacre genocide goddamn cocaine heroin "
    "molest molested incest pedophile terrorist terrorism slaughter slaughtered"
).split()
SOFT = (
    "kill killed killing kills murder murdered corpse drug drugs damn hell crap "
    "blood bloody gun shoot shot dead die died death war bomb weapon alcohol "
    "drunk beer wine cigarette smoke divorce religion god"
).split()
#: Fixed value: a sentence with a larger share of proper nouns is no example.
MOST_NAMES = 0.3


def article_sentences(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """STR-07, FLT-02: sentences of 20 to 300 characters, with their place in the text."""
    parts = docs.select(*keep, F.posexplode(T.sentences(text)).alias("place", "sentence"))
    return parts.withColumn("sentence", F.trim("sentence")).where(F.length("sentence").between(20, 300))


def distinct_sentences(sentences: DataFrame, order: list[Column]) -> DataFrame:
    """SET-01, SET-02, T15: texts that differ in case alone are one; the first in order stays.

    Rows meet by the lower-cased text itself, not by a hash of it.
    """
    return first_by(sentences.withColumn("_key", F.lower("sentence")), ["_key"], order).drop("_key")


def clean_sentences(docs: DataFrame) -> DataFrame:
    """The flagship chain: sentences that FLT-02 and FLT-01 keep, each once; columns doc_id, place, sentence."""
    found = article_sentences(docs, "text", "doc_id").where(T.plausible_sentence("sentence"))
    return distinct_sentences(found, [F.col("doc_id"), F.col("place")])


def word_counts(sentences: DataFrame) -> DataFrame:
    """AGG-01, AGG-02: partial counts in each task, then the sum."""
    return sentences.select(F.explode(T.tokens("sentence")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequency_ranks(counts: DataFrame) -> DataFrame:
    """WIN-01, WIN-17: rank by count, ties by word, and the band of the frequent ones."""
    ranked = global_rank(counts, [F.desc("n"), F.asc("word")])
    band = F.when(F.col("freq_rank") <= 3000, "Top 3000").when(F.col("freq_rank") <= 5000, "Top 5000")
    return ranked.withColumn("freq_band", band)


def log_dice(both: Column, x: Column, y: Column) -> Column:
    """AGG-03, AGG-04 (counts of a sample are scaled before)."""
    return 14 + F.log2(2 * both / (x + y))


def adjacent_pairs(sentences: DataFrame) -> DataFrame:
    """Neighbouring words as a collocation relation, where no parse is at hand: left, right, n."""
    words = sentences.select(T.tokens("sentence").alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("left"), F.element_at("w", i + 1).alias("right")))
    return words.select(F.explode(pairs).alias("p")).select("p.left", "p.right").groupBy("left", "right").agg(F.count("*").alias("n"))


def kept_counts(counts: DataFrame, least: int = COLL_MIN_N) -> DataFrame:
    """AGG-07: counts of ``least`` or more; nothing is pruned while counting, so they are exact."""
    return counts.where(F.col("n") >= least)


def heavy_words(sentences: DataFrame, share: float, held: int | None = None) -> DataFrame:
    """AGG-07: word, estimate and bound of all words that make up ``share`` or more of all words, and of few others: estimate <= count <= estimate + bound.

    Frequent items by Misra and Gries (1982): a task keeps ``held`` counters, by default twice as many as words can have that share; when they are full all lose as
    much as the smallest of the larger half has, which is noted.  Counters of all tasks add up, and so do what they lost, so memory and what is sent don't grow with the vocabulary.
    """
    ship(sentences.sparkSession)
    most = held or int(2 / share) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        lost = total = 0
        for b in batches:
            for words in b.column(0).to_pylist():
                met.update(words)
                total += len(words)
                if len(met) > 2 * most:
                    less = sorted(met.values(), reverse=True)[most]
                    lost += less
                    met = Counter({w: n - less for w, n in met.items() if n > less})
        yield pa.RecordBatch.from_arrays([pa.array([None, *met], pa.string()), pa.array([lost, *met.values()], pa.int64()), pa.array([total] + [0] * len(met), pa.int64())], names=["word", "n", "total"])

    sums = cut(sentences.select(T.tokens("sentence").alias("words")).mapInArrow(run, "word string, n bigint, total bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    # One row of what all tasks lost and read.
    whole = sums.where("word IS NULL").select(F.col("n").alias("bound"), F.col("total").alias("_total"))
    return sums.where("word IS NOT NULL").select("word", F.col("n").alias("estimate")).join(F.broadcast(whole), F.lit(True)).where(F.col("estimate") + F.col("bound") >= F.lit(share) * F.col("_total")).drop("_total")


def partial_counts(sentences: DataFrame, path: str) -> DataFrame:
    """BAT-03: each chunk's counts as a partition of a table; a chunk that is there isn't counted again.  Returns the sums of all.

    sentences: chunk and sentence.
    """
    spark = sentences.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    todo = sentences.join(spark.read.parquet(path).select("chunk").distinct(), "chunk", "left_anti") if there else sentences
    # A chunk is of bounded size and in one task, so it is one file, not one for each task.
    todo.select("chunk", "sentence").repartition("chunk").select("chunk", F.explode(T.tokens("sentence")).alias("word")).groupBy("chunk", "word").agg(F.count("*").alias("n")).write.mode("append").partitionBy("chunk").parquet(path)
    return spark.read.parquet(path).groupBy("word").agg(F.sum("n").alias("n"))


def associations(pairs: DataFrame, counts: DataFrame, min_n: int = COLL_MIN_N, min_ld: float = COLL_MIN_LD) -> DataFrame:
    """AGG-03: left, right, n, logdice of pairs that pass; counts has word and n."""
    x = counts.select(F.col("word").alias("left"), F.col("n").alias("fx"))
    y = counts.select(F.col("word").alias("right"), F.col("n").alias("fy"))
    scored = kept_counts(pairs, min_n).join(x, "left").join(y, "right").withColumn("logdice", log_dice(F.col("n"), F.col("fx"), F.col("fy")))
    return scored.where(F.col("logdice") >= min_ld).select("left", "right", "n", "logdice")


def ranked_collocations(coll: DataFrame, k: int = COLL_TOP) -> DataFrame:
    """WIN-04, WIN-06: rank in (lemma, pos, pattern); do or have leads its list if no other verb is as frequent there."""
    group = W.partitionBy("lemma", "pos", "pattern")
    leads = (F.col("pos") == "NOUN") & (F.col("pattern") == "verb_w") & F.col("colloc").isin(*LIGHT_VERBS) & (F.col("n") == F.max("n").over(group))
    return top_k(coll.withColumn("_leads", leads), ["lemma", "pos", "pattern"], [F.desc("_leads"), F.desc("logdice"), F.desc("n"), F.asc("display")], k, "rank").drop("_leads")


def rare_pos(counts: DataFrame) -> DataFrame:
    """FLT-16: (lemma, pos) pairs that are a small share of a lemma seen often, likely tagging errors."""
    total = F.sum("n").over(W.partitionBy("lemma"))
    return counts.withColumn("_total", total).where((F.col("_total") >= POS_SHARE_N) & (F.col("n") / F.col("_total") < POS_SHARE_MIN)).select("lemma", "pos")


def passes(n: Column, ratio: Column, lift: Column, pos: Column) -> Column:
    """FLT-17; a part of speech without thresholds doesn't pass (T24)."""
    out = F.lit(False)
    for p, (a, b, c) in PREP_MIN.items():
        out = F.when(pos == p, (n >= a) & (ratio >= b) & (lift >= c)).otherwise(out)
    return out


def prep_patterns(prep: DataFrame, node: DataFrame, pos_prep: DataFrame, pos_token: DataFrame) -> DataFrame:
    """AGG-05, AGG-06, FLT-17, FLT-18: prep (lemma, pos, prep, obj, n), node (lemma, pos, n), pos_prep (pos, prep, n), pos_token (pos, n)."""
    objs = prep.where("obj IS NOT NULL").groupBy("lemma", "pos", "prep", "obj").agg(F.sum("n").alias("on"))
    total = prep.groupBy("lemma", "pos", "prep").agg(F.sum("n").alias("n")).where("n >= 5")
    best = top_k(objs, ["lemma", "pos", "prep"], [F.desc("on"), F.asc("obj")], 3, "rank").join(total, ["lemma", "pos", "prep"])
    shown = best.where(F.col("on") >= F.greatest(F.lit(2.0), 0.15 * F.col("n"))).groupBy("lemma", "pos", "prep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "obj"))), lambda x: x["obj"]), " / ").alias("obj"))
    base = pos_prep.withColumnRenamed("n", "pn").join(pos_token.withColumnRenamed("n", "tn"), "pos")
    rows = total.join(node.withColumnRenamed("n", "occ"), ["lemma", "pos"]).join(base, ["pos", "prep"]).join(shown, ["lemma", "pos", "prep"], "left")
    rows = rows.join(rare_pos(node), ["lemma", "pos"], "left_anti")
    rows = rows.withColumn("ratio", F.col("n") / F.greatest(F.lit(1), F.col("occ"))).withColumn("lift", F.col("ratio") / F.greatest(F.lit(1e-9), F.col("pn") / F.greatest(F.lit(1), F.col("tn")))).withColumn("obj", F.coalesce("obj", F.lit("")))
    doing = F.col("obj").contains("doing") & (F.col("n") >= 30) & (F.col("ratio") >= 0.1) & (F.col("lift") >= 1.2)
    ok = passes(F.col("n"), F.col("ratio"), F.col("lift"), F.col("pos")) | doing
    return rows.select("lemma", "pos", "prep", "obj", "n", "ratio", "lift", ok.alias("pass"), F.when(ok, F.when(F.col("ratio") >= 0.2, "common").otherwise("less common")).otherwise("").alias("label"))


def passing_sequences(seq: DataFrame, patterns: DataFrame) -> DataFrame:
    """JOIN-19: two-preposition strings with a preposition that passes."""
    words = seq.where(F.col("n") >= SEQ_MIN_N).withColumn("prep", F.explode(F.split("seq", " "))).where(~F.col("prep").isin("sb", "sth", "doing", "wh-"))
    return words.join(patterns.where("pass").select("lemma", "pos", "prep"), ["lemma", "pos", "prep"], "left_semi").select("lemma", "pos", "seq", "n").distinct()


#: Second prepositions of place or time, which are no part of a pattern.
ADVERBIAL = "in at during after before since until within through throughout around near over under".split()


def shown_sequences(seq: DataFrame) -> DataFrame:
    """FLT-25: often enough, a complement for each preposition, and no later preposition of place or time."""
    parts = F.split("seq", " ")
    objects = F.filter(parts, lambda x: x.isin("sb", "sth", "wh-"))
    preps = F.filter(parts, lambda x: ~x.isin("sb", "sth", "wh-", "doing"))
    return seq.where((F.col("n") >= 20) & (F.size(objects) >= F.size(preps)) & ~F.exists(F.slice(preps, 2, 99), lambda p: p.isin(ADVERBIAL)))


def reject_reason(sentence: Column, words: Column, names: Column, blocked: list[str] = BLOCKED) -> Column:
    """FLT-03..06, AGG-18: the first of six reasons that applies, null for a good sentence.

    words are in lower case; names is the number of proper nouns.
    """
    n = F.size(words)
    ended = F.substring(sentence, 1, 1).rlike(r"^\p{Lu}") & F.substring(sentence, -1, 1).isin(".", "!", "?")
    hit = F.arrays_overlap(words, F.array(*[F.lit(x) for x in blocked])) if blocked else F.lit(False)
    reason = F.when(~n.between(5, 35), "length").when(~ended, "not whole").when(T.has_odd_characters(sentence), "characters").when(T.has_personal_data(sentence), "personal")
    return reason.when(hit, "blocked").when(names / n > MOST_NAMES, "names")


def soft_words(words: Column, soft: list[str] = SOFT) -> Column:
    """FLT-06: how many words count against a sentence."""
    return F.size(F.filter(words, lambda w: w.isin(soft)))


def sentence_score(words: Column, common: Column, names: Column, soft: Column) -> Column:
    """MTH-02: common is the share of common words, names and soft are counts."""
    n = F.size(words)
    return 2.0 * common - 0.4 * names - 1.0 * soft + F.when(n.between(8, 20), 1.0).otherwise(0.0) - F.when(F.element_at(words, 1).isin(OPENING_PRONOUNS), 0.6).otherwise(0.0)


#: Sentences of each kind that stay as candidates until the last choice.
CANDIDATES = {"role": 8, "prep": 3, "seq": 1}


def kept_candidates(examples: DataFrame, k: dict[str, int] = CANDIDATES) -> DataFrame:
    """WIN-07: the best k sentences of each (lemma, pos, kind, key) by score, k by kind; ties by sentence."""
    most = F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    # The largest k is pushed below the shuffle; the kind's own decides then.
    best = top_k(examples, ["lemma", "pos", "kind", "key"], [F.desc("score"), F.asc("sentence")], max(k.values()), "place")
    return best.where(F.col("place") <= most[F.col("kind")])


def good_examples(examples: DataFrame, k: int, by: list[str], family: str = "family") -> DataFrame:
    """WIN-02, WIN-03, WIN-11: k examples a key by score, balanced over source families, each text once."""
    once = first_by(examples.withColumn("_text", F.lower("sentence")), [*by, "_text"], [F.desc("score"), F.asc(family), F.asc("sentence")]).drop("_text")
    return balanced_pick(once, by, family, [F.desc("score"), F.asc("sentence")], k)


def chunked(sentences: DataFrame, order: list[Column], size: int = 100_000) -> DataFrame:
    """BAT-01: adds chunk, numbered in order; chunks are written as partitions, and those present are skipped."""
    return global_rank(sentences, order, "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def with_texts(chosen: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """BAT-04: texts join last, when few rows are left."""
    return chosen.join(texts, on)
