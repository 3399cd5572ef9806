"""Language identification by words first, then by ever shorter character n-grams.

The model holds, for each language, log frequencies of words and of n-grams of 5 to 1 characters (words padded with
a space on both sides).  A word that training has seen is scored by its log frequency in each language.  An unseen
word is scored by the longest n-grams that training has seen: all of its known 5-grams, else its known 4-grams, and
so on down to single characters.

Fitting reads a bounded sample: about ``per_language`` labelled rows of each language, chosen by a hash of the key.
Every word and n-gram of the sample is counted in a distributed aggregation and kept: the model is a sorted array of
64-bit hashes and an array of log frequencies for each order, some 20 bytes an entry.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import crc_mod, map_rows, pick, plain, shared, small_batches, trim


def _number_signs() -> str:
    """Ranges, for a character class, of the numerals that aren't decimal digits, such as fractions and Roman numerals; no letters."""
    found = [c for c in range(0x20000) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    starts = [c for c in found if c - 1 not in set(found)]
    ends = [c for c in found if c + 1 not in set(found)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


#: Runs of letters, in lower case.
WORD = re.compile(rf"[^\W\d_{_number_signs()}]+")
#: Longest n-gram of an unseen word.
LONGEST = 5
#: Words that a task remembers before it starts anew; bounds its memory.
REMEMBERED = 100_000
#: Code points of words scored at once.
WINDOW = 1 << 18
UNKNOWN = "und"
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n code points."""
    h = np.full(max(0, len(x) - n + 1), n, np.uint64)
    for i in range(n):
        h ^= h >> np.uint64(32)
        h = (h + x[i:i + len(h)]) * _P
    h ^= h >> np.uint64(29)
    return h * _Q


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash among sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


class Model:
    """For each order (0 for words) sorted hashes and, for each, a row of log frequencies, one column for each language."""

    def __init__(self, languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages, self.tables = languages, tables

    def word_rows(self, words: list[str]) -> np.ndarray:
        """The evidence of each of some distinct words."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        keys, logs = self.tables[0]
        at = _find(keys, word_hashes(words))
        out[at >= 0] = logs[at[at >= 0]]
        unseen = np.flatnonzero(at < 0)
        done = 0
        while done < len(unseen):
            part, size = [], 0
            while done < len(unseen) and (not part or size < WINDOW):
                part.append(unseen[done])
                size += len(words[unseen[done]]) + 2
                done += 1
            self._back_off(words, np.array(part), out)
        return out

    def _back_off(self, words: list[str], open_: np.ndarray, out: np.ndarray) -> None:
        for n in range(LONGEST, 0, -1):
            keys, logs = self.tables[n]
            sizes = np.array([len(words[i]) + 2 for i in open_])
            ends = np.cumsum(sizes)
            h = gram_hashes(_points("".join([f" {words[i]} " for i in open_])), n)
            place = np.arange(len(h))
            word = np.searchsorted(ends, place, side="right")
            at = _find(keys, h)
            known = (at >= 0) & (place + n <= ends[word])
            word, at = word[known], at[known]
            if len(at):
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                sums = np.add.reduceat(logs[at], first, axis=0, dtype=float)
                out[open_[word[first]]] = sums / np.diff(np.r_[first, len(at)])[:, None]
                open_ = np.delete(open_, word[first])
            if not len(open_):
                return


class Predictor:
    """A model with the evidence of words it has met; REMEMBERED of them at most, beside those of the texts at hand."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.at) > REMEMBERED:
            self._forget()
        at = self.at
        new = list({w for words in found for w in words if w not in at})
        if new:
            rows = self.model.word_rows(new)
            n = len(at)
            at.update(zip(new, range(n, n + len(new))))
            if len(at) > len(self.rows):
                self.rows = np.resize(self.rows, (2 * len(at), self.rows.shape[1]))
            self.rows[n:len(at)] = rows
        out = []
        for words in found:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            ids = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            # Words of a text are not independent: the evidence is damped by the root of their number.
            x = self.rows[ids].sum(axis=0, dtype=float) / math.sqrt(len(words))
            p = np.exp(x - x.max())
            best = int(p.argmax())
            out.append((self.model.languages[best], float(p[best] / p.sum())))
        return out


def fit(rows: DataFrame, per_language: int = 1500) -> Model:
    """Learns from columns doc_id, text and lang: from about ``per_language`` rows of each language, whatever keys they have.

    The driver gets every word and n-gram of these rows, so its share is bounded by their number and the length of their texts.  Rows without text or lang teach nothing.  Languages are taken in code-point order, so ties go to the first.
    No rows give a model that answers "und".
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [])
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, per_language / sizes[x]))) for x in languages])
    # By key and text, so that rows without a key have fates of their own; repeated rows share one and teach once.
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share * 1_000_003).select("doc_id", "lang", "text").distinct().select("lang", "text")

    def word_counts():
        def f(langs: list, texts: list) -> list[tuple]:
            out: Counter = Counter()
            for lang, text in zip(langs, texts):
                out.update((lang, w) for w in WORD.findall(text.lower()))
            return [(*key, k) for key, k in out.items()]

        return f

    def gram_counts():
        def f(langs: list, words: list, counts: list) -> list[tuple]:
            out: Counter = Counter()
            for lang, w, k in zip(langs, words, counts):
                out[lang, 0, w] += k
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        out[lang, n, g] += k
            return [(*key, k) for key, k in out.items()]

        return f

    words = map_rows(chosen, "lang string, item string, k bigint", word_counts).groupBy("lang", "item").agg(F.sum("k").alias("k"))
    counts = map_rows(words, "lang string, n int, item string, k bigint", gram_counts, rows=2_000)
    items = counts.groupBy("n", "item").agg(*[F.sum(F.when(F.col("lang") == x, F.col("k")).otherwise(0)).alias(f"k{i}") for i, x in enumerate(languages)])
    got = items.toArrow()
    order, seen = got.column("n").to_numpy(), np.stack([got.column(f"k{i}").to_numpy() for i in range(len(languages))], axis=1).astype(float)
    tables = []
    for n in range(LONGEST + 1):
        mine = np.flatnonzero(order == n)
        names = got.column("item").take(pa.array(mine)).to_pylist()
        h = word_hashes(names) if n == 0 else gram_hashes(_points("".join(names)), n)[::n] if names else np.zeros(0, np.uint64)
        # Half a count for what a language lacks; the same floor for all, relative to the language's total.
        logs = np.log((seen[mine] + 0.5) / (seen[mine].sum(axis=0) + 0.5 * (len(mine) + 1)))
        logs -= logs.mean(axis=1, keepdims=True)
        by = np.argsort(h)
        tables.append((h[by], logs[by].astype(np.float32)))
    return Model(languages, tables)


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1), one row for each row.

    Null texts and texts without a letter are "und" with score 0; whole texts are read however long.  Repeated rows each
    come back; an empty table gives no rows.
    """
    predictor = shared(df, model, Predictor)

    def start():
        p = predictor()
        return lambda keys, texts: [(k, *found) for k, found in zip(keys, p.predict(texts))]

    return map_rows(pick(df, key, text), f"doc_id {dict(df.dtypes)[key]}, lang_pred string, score double", start)


def held_out_split(df: DataFrame, folds: int = 5, fold: int = 0, key: str = "doc_id") -> DataFrame:
    """doc_id, text, lang and held_out: crc32 of the key as text, modulo folds, is ``fold``; false for a null key."""
    rows = pick(df, key, "text", "lang").toDF("doc_id", "text", "lang")
    return rows.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), folds) == fold, F.lit(False)))


def keep_known(df: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose text is in a language; "und" goes, so null and letterless texts do.

    A null lang takes the prediction.  Repeated rows all stay or all go; an empty table stays empty; other columns, even
    ones whose names differ only in case, are left as they are.
    """
    predictor = shared(df, model, Predictor)
    at, lang = df.columns.index("text"), df.columns.index("lang") if "lang" in df.columns else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = predictor()
        for whole in batches:
            k = 0
            while k < whole.num_rows:
                n = min(256, whole.num_rows - k)
                while n > 1 and whole.slice(k, n).nbytes > 4 << 20:
                    n //= 2
                b = whole.slice(k, n)
                k += n
                found = [x for x, _ in p.predict(b.column(at).to_pylist())]
                columns = list(b.columns)
                if lang is not None:
                    columns[lang] = pa.array([x.as_py() if x.is_valid else y for x, y in zip(columns[lang], found)], b.schema.field(lang).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array([x != UNKNOWN for x in found], pa.bool_()))
        trim()

    small_batches(df.sparkSession)
    rows = plain(df)
    return rows.mapInArrow(keep, rows.schema).toDF(*df.columns)
