"""Parts of speech by a hidden Markov model that is fitted to raw sentences (LNG-01).

States are parts of speech.  Words of closed classes are tied to theirs by short lists, and endings make other words lean one way at first; rounds of
expectation-maximisation (Baum and Welch) over all sentences do the rest.  A word is seen as itself if it is closed or one of the most frequent, else by its ending, so a
round's statistics are a table of bounded size: tasks add up expected counts, the cluster adds up tasks, and the driver makes the next model of the sums.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators.linguistic import TOKEN
from wordloom.operators.tables import cut
from wordloom.session import ship

STATES = ["NOUN", "VERB", "ADJ", "ADV", "ADP", "DET", "PRON", "CCONJ", "AUX"]
OPEN = 4
#: Words of closed classes; one in two lists may be either.
CLOSED = {
    "ADP": "of in to for with on at by from into about over after before between through under during without against among",
    "DET": "the a an this that these those each every some any no all both",
    "PRON": "i you he she it we they me him her us them who what which myself himself herself itself",
    "CCONJ": "and or but nor yet so if because while although that",
    "AUX": "be is are was were been being am have has had do does did can could will would shall should may might must",
}
#: Endings that make a word lean to a state before the first round.
ENDINGS = {"ADV": ("ly",), "VERB": ("ed", "ing", "ize", "ise", "ify"), "ADJ": ("ous", "ful", "able", "ible", "al", "ive", "ic", "less"), "NOUN": ("tion", "ness", "ment", "ity", "er", "or", "ism", "s")}
LEAN = 5.0
#: Tags of tokens by part of speech, where the ending doesn't tell more.
TAGS = {"NOUN": "NN", "VERB": "VB", "ADJ": "JJ", "ADV": "RB", "ADP": "IN", "DET": "DT", "PRON": "PRP", "CCONJ": "CC", "AUX": "MD"}
WORD = re.compile("[a-z][a-z']*")


@dataclass
class Model:
    """Symbols by name, and probabilities of first states, of a state after a state, and of a symbol in a state; likelihood is the last round's, in logs."""

    symbols: dict[str, int]
    start: np.ndarray
    follow: np.ndarray
    emit: np.ndarray
    likelihood: float = -np.inf

    def ids(self, words: list[str]) -> list[int]:
        """The words' symbols; one that was never seen is as good as any."""
        return [self.symbols.get(w, self.symbols.get(ending(w), len(self.symbols))) for w in words]


def ending(word: str) -> str:
    return "~" + word[-2:]


def first_model(counts: dict[str, int]) -> Model:
    """Before the first round, from how often each symbol (a word or an ending) is there."""
    names = sorted(counts)
    weight = np.zeros((len(STATES), len(names)))
    for v, name in enumerate(names):
        closed = [STATES.index(s) for s, ws in CLOSED.items() if name in ws.split()]
        for k in closed or range(OPEN):
            lean = any(name.endswith(e) for e in ENDINGS.get(STATES[k], ())) and not closed
            # Words that nothing tells apart would stay together for good.
            weight[k, v] = (LEAN if lean else 1.0) * (1 + 0.2 * ((v * 7 + k * 3) % 11) / 11)
    emit = weight * np.array([counts[n] for n in names])
    n = len(STATES)
    follow = 1 + 0.1 * ((np.arange(n * n) * 5 % 13) / 13).reshape(n, n)
    return Model({w: i for i, w in enumerate(names)}, np.full(n, 1 / n), follow / follow.sum(axis=1, keepdims=True), emit / np.maximum(emit.sum(axis=1, keepdims=True), 1e-300))


def _listed(sentences: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols one after the other, and how many each sentence has."""
    return np.array([x for s in sentences for x in s], np.int64), np.array([len(s) for s in sentences], np.int64)


def _by_place(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sentences' order, the longest first, and for each place the symbols of those that reach it; sentences aren't empty.

    Whoever goes from place to place finds those that go on ahead of the others, so nothing is padded.
    """
    order = np.argsort(-size, kind="stable")
    begins = (np.cumsum(size) - size)[order]
    reach = len(size) - np.searchsorted(np.sort(size), np.arange(size.max()), side="right")
    return order, [ids[begins[:n] + t] for t, n in enumerate(reach)]


def _expected(m: Model, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    k, total = len(STATES), 0.0
    places = _by_place(ids, size)[1]
    known = np.vstack([m.emit.T, np.ones((1, k))])
    e = [known[x] for x in places]
    ahead: list[np.ndarray] = []
    scale: list[np.ndarray] = []
    for t, here in enumerate(e):
        p = (ahead[-1][:len(here)] @ m.follow if t else m.start) * here
        s = p.sum(axis=1)
        ahead.append(p / s[:, None])
        scale.append(s)
        total += float(np.log(s).sum())
    pairs, back = np.zeros((k, k)), np.ones_like(e[-1])
    for t in range(len(e) - 1, -1, -1):
        n = len(e[t])
        if t:
            after = e[t] * back / scale[t][:, None]
            pairs += ahead[t - 1][:n].T @ after * m.follow
        ahead[t] *= back
        if t:
            back = np.ones_like(e[t - 1])
            back[:n] = after @ m.follow.T
    every, both = np.concatenate(places), np.concatenate(ahead)
    symbols = np.stack([np.bincount(every, both[:, i], len(m.symbols) + 1)[:-1] for i in range(k)])
    return ahead[0].sum(axis=0), pairs, symbols, total


def expected(m: Model, sentences: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first states, of states after states and of symbols in states, and the log likelihood; sentences aren't empty."""
    return _expected(m, *_listed(sentences))


def _best_states(m: Model, ids: np.ndarray, size: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    """The likeliest states, one after the other as the symbols are."""
    order, places = _by_place(ids, size)
    with np.errstate(divide="ignore"):
        known, follow, p = np.log(np.vstack([m.emit.T, np.ones((1, len(STATES)))])), np.log(np.maximum(m.follow, floor)), np.log(np.maximum(m.start, floor))
    # A word that no state has is left to its neighbours.
    known[np.isneginf(known).all(axis=1)] = 0
    p, came, last = p + known[places[0]], [], np.zeros(len(size), np.int64)
    for x in places[1:]:
        # Sentences that are over end in their best state.
        last[len(x):len(p)] = p[len(x):].argmax(axis=1)
        p = p[:len(x)]
        best, way = p[:, :1] + follow[0], np.zeros((len(x), len(STATES)), np.int8)
        for k in range(1, len(STATES)):
            each = p[:, k:k + 1] + follow[k]
            way[each > best] = k
            np.maximum(best, each, out=best)
        came.append(way)
        p = best + known[x]
    last[:len(p)] = p.argmax(axis=1)
    begins, out, at = (np.cumsum(size) - size)[order], np.zeros(len(ids), np.int64), last
    for t in range(len(places) - 1, -1, -1):
        n = len(places[t])
        out[begins[:n] + t] = at[:n]
        if t:
            at = at.copy()
            at[:n] = came[t - 1][np.arange(n), at[:n]]
    return out


def best_states(m: Model, sentences: list[list[int]], floor: float = 1e-12) -> list[list[int]]:
    """The likeliest states of each sentence (Viterbi); ties go to the first state."""
    if not sentences:
        return []
    ids, size = _listed(sentences)
    return [x.tolist() for x in np.split(_best_states(m, ids, size, floor), np.cumsum(size)[:-1])]


#: Words of sentences that are worked on at once, about.
RUN = 1 << 15


def _runs(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of sentences with about RUN words each."""
    upto, at = np.cumsum(size), 0
    while at < len(size):
        end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + RUN, side="right")), at + 1)
        yield at, end
        at = end


def _codes(m: Model, words: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The words' symbols, the distinct words, and which of them each is: a word is looked up once, however often it is there."""
    coded = words.dictionary_encode()
    names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    return np.array(m.ids(names), np.int32)[of], names, of


def symbol_counts(words: DataFrame, most: int) -> dict[str, int]:
    """How often each symbol is there, of a frame of words: closed words, the ``most`` most frequent others, and endings of the rest."""
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    closed = sorted({w for ws in CLOSED.values() for w in ws.split()})
    own = counts.where(F.col("word").isin(closed)).unionByName(counts.where(~F.col("word").isin(closed)).orderBy(F.desc("n"), F.asc("word")).limit(most))
    rest = counts.join(own.select("word"), "word", "left_anti").groupBy(F.concat(F.lit("~"), F.substring("word", -2, 2)).alias("word")).agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in own.unionByName(rest).collect()}


def fit(sentences: DataFrame, rounds: int = 5, most: int = 2000, watch: Callable[[float], None] | None = None) -> Model:
    """Learns from a column sentence; ``watch`` gets the log likelihood before each round's step, which never falls.

    Null and empty sentences teach nothing; none at all give the first model.
    """
    spark, listed = sentences.sparkSession, sentences.select(T.tokens("sentence").alias("words"))
    ship(spark)
    m = first_model(symbol_counts(listed.select(F.explode("words").alias("word")), most))
    named = spark.sparkContext.broadcast(m)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words = b.column(0)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(words.offsets.to_numpy() - words.offsets[0].as_py(), pa.int32()), pa.array(_codes(named.value, words.flatten())[0]))], names=["ids"])

    # Rounds read numbers, not words.
    coded = cut(listed.mapInArrow(code, "ids array<int>")) if m.symbols else None
    for _ in range(rounds if m.symbols else 0):
        sent, states = spark.sparkContext.broadcast(m), len(STATES)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, states=states) -> Iterator[pa.RecordBatch]:
            m = sent.value
            total = [np.zeros(states), np.zeros((states, states)), np.zeros((states, len(m.symbols))), np.zeros(1)]
            for b in batches:
                size = np.diff(b.column(0).offsets.to_numpy())
                size = size[size > 0]
                ids, upto = b.column(0).flatten().to_numpy(), np.r_[0, np.cumsum(size)]
                for i, j in _runs(size):
                    for own, more in zip(total, _expected(m, ids[upto[i]:upto[j]], size[i:j])):
                        own += more
            flat = np.concatenate([x.ravel() for x in total])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

        sums = np.zeros(states + states**2 + states * len(m.symbols) + 1)
        for r in coded.mapInArrow(run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            sums[r["at"]] = r.n
        start, follow, emit = sums[:states], sums[states:states + states**2].reshape(states, states), sums[states + states**2:-1].reshape(states, -1)
        if watch:
            watch(float(sums[-1]))
        share = lambda x, old: np.where(x.sum(axis=-1, keepdims=True) > 0, x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300), old)
        m = Model(m.symbols, share(start, m.start), share(follow, m.follow), share(emit, m.emit), float(sums[-1]))
    return m


def _tag(word: str, pos: str) -> str:
    if pos == "NOUN" and word.endswith("s"):
        return "NNS"
    if pos == "VERB":
        return next((t for e, t in (("ing", "VBG"), ("ed", "VBD"), ("s", "VBZ")) if word.endswith(e)), "VB")
    return TAGS[pos]


def annotator(m: Model) -> Callable[[], Callable[[list[str]], list[list[dict]]]]:
    """For ``linguistic.annotate``: tokens with parts of speech and tags; no dependencies are told, so each token is its own head."""

    def start() -> Callable[[list[str]], list[list[dict]]]:
        closed = {w for ws in CLOSED.values() for w in ws.split()}

        def f(texts: list[str]) -> list[list[dict]]:
            met = [[(x.group(), x.start()) for x in WORD.finditer((t or "").lower())] for t in texts]
            some = [i for i, words in enumerate(met) if words]
            states: dict[int, list[int]] = {}
            for k in range(0, len(some), 256):
                part = some[k:k + 256]
                states |= dict(zip(part, best_states(m, [m.ids([w for w, _ in met[i]]) for i in part])))
            return [
                [
                    {"i": n, "text": w, "lemma": w, "pos": (p := STATES[s]), "tag": _tag(w, p), "dep": "", "head": n, "is_alpha": w.isalpha(), "is_stop": w in closed, "ent_type": "", "char_start": at}
                    for n, ((w, at), s) in enumerate(zip(words, states.get(i, [])))
                ]
                for i, words in enumerate(met)
            ]

        return f

    return start


def annotate(sentences: DataFrame, m: Model, names: list[str] | None = None) -> DataFrame:
    """TOKEN rows as ``linguistic.annotate`` makes them with ``annotator``, or those of their columns that are named; a batch is worked out by column."""
    ship(sentences.sparkSession)
    fields = [x for x in TOKEN.split(", ") if names is None or x.split()[0] in names]
    sent = sentences.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, closed = sent.value, {w for ws in CLOSED.values() for w in ws.split()}
        for b in batches:
            words, of, at = _words_of(b.column(1).to_pylist())
            if not len(of):
                continue
            ids, known, which = _codes(m, words)
            # Only sentences with words have a size.
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            size = np.diff(np.r_[first, len(of)])
            upto = np.r_[first, len(of)]
            states = np.concatenate([_best_states(m, ids[upto[i]:upto[j]], size[i:j]) for i, j in _runs(size)])
            place = (np.arange(len(of)) - np.repeat(first, size)).astype(np.int32)
            each = lambda f: pa.array([f(w) for w in known]).take(pa.array(which))
            make = {
                "sent_id": lambda: b.column(0).take(pa.array(of)), "i": lambda: pa.array(place), "text": lambda: words, "lemma": lambda: words, "pos": lambda: pa.array(STATES).take(pa.array(states)), "tag": lambda: _tags(known, which, states),
                "dep": lambda: pa.array([""]).take(pa.array(np.zeros(len(of), np.int64))), "head": lambda: pa.array(place), "is_alpha": lambda: each(str.isalpha), "is_stop": lambda: each(closed.__contains__),
                "ent_type": lambda: pa.array([""]).take(pa.array(np.zeros(len(of), np.int64))), "char_start": lambda: pa.array(at.astype(np.int32)),
            }
            asked = [x.split()[0] for x in fields]
            yield pa.RecordBatch.from_arrays([make[x]() for x in asked], names=asked)

    return sentences.select("sent_id", "sentence").mapInArrow(run, ", ".join(fields))


def _tags(known: list[str], which: np.ndarray, states: np.ndarray) -> pa.Array:
    pairs, of = np.unique(which.astype(np.int64) * len(STATES) + states, return_inverse=True)
    return pa.array([_tag(known[x // len(STATES)], STATES[x % len(STATES)]) for x in pairs.tolist()]).take(pa.array(of))


def _words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts as WORD finds them in lower case, with the text and the place in it of each.

    A run of letters and apostrophes is a word from its first letter on, so words are cut out of all texts at once.
    """
    low = [(t or "").lower() for t in texts]
    begins = np.cumsum([0] + [len(t) + 1 for t in low])
    # No word goes over the end of a text.
    x = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (x >= ord("a")) & (x <= ord("z"))
    change = np.diff(np.r_[False, letter | (x == ord("'")), False].astype(np.int8))
    runs, ends, letters = np.flatnonzero(change == 1), np.flatnonzero(change == -1), np.flatnonzero(letter)
    start = np.r_[letters, len(x)][np.searchsorted(letters, runs)]
    start, ends = start[start < ends], ends[start < ends]
    offsets = np.r_[0, np.cumsum(ends - start)]
    inside = np.repeat(start - offsets[:-1], ends - start) + np.arange(offsets[-1])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(x[inside].astype(np.uint8)))
    of = np.searchsorted(begins, start, side="right") - 1
    return words, of, start - begins[of]
