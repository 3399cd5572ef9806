"""Secret scanning with stochastic automata that are inferred from credentials.

Base patterns find assigned secrets, access keys and long hexadecimal runs.  Their values are the labelled
credentials: for each kind a prefix tree of a bounded sample is folded into a probabilistic automaton by merging
states whose outgoing and ending frequencies agree within a Hoeffding bound (ALERGIA: Carrasco and Oncina, 1994).
Ordinary words of the same texts give a background automaton.  Every candidate in a text, each whole run of
credential characters, is then scored: its log likelihood under the best credential automaton less that under the
background.  A candidate is a secret if that is THRESHOLD a character and MARGIN in all, as much as a run of 16
characters just at the threshold has; so a short one needs a clearer format.  Plain numbers and words are background
too, whatever the sample held of them.  Secrets are added to the base spans.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut, map_rows, pick, plain, shared, small_batches, trim

#: Fixed patterns, by kind, and the fewest characters of the part that decides.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "learned")
#: What may be a credential without a keyword before it: runs of as many characters as a base value has at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: Log likelihood above the background, for each character and in all, that makes a candidate a secret.
THRESHOLD, MARGIN = 0.7, 0.7 * 16
#: What the background is learned from.
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{4,}")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and value of the base matches, by start and then in the kinds' order; ends are exclusive."""
    found = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found)]


def symbols(value: str) -> str:
    """A value in the automata's alphabet: digits 0, hexadecimal letters a and A, other letters z and Z, signs themselves."""
    return value.translate(_SYMBOLS)


_SYMBOLS = str.maketrans(
    {**{c: "0" for c in string.digits}, **{c: "a" if c in "abcdef" else "z" for c in string.ascii_lowercase}, **{c: "A" if c in "ABCDEF" else "Z" for c in string.ascii_uppercase}}
)
ALPHABET = 5 + len("+/_.=-")


class Automaton:
    """A deterministic stochastic automaton, learned by folding a prefix tree."""

    def __init__(self, samples: list[str], alpha: float = 0.05) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.hits: list[Counter] = [Counter()]
        self.ends = [0]
        for s in samples:
            at = 0
            for c in s:
                self.hits[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.hits.append(Counter())
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._fold()
        self._weigh()

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.hits[q].values())

    def _alike(self, p: int, q: int) -> bool:
        """Whether two states' frequencies, and those of the states after them, agree; q's side is a finite tree."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self._total(p), self._total(q)
            if n and m:
                limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
                if abs(self.ends[p] / n - self.ends[q] / m) > limit:
                    return False
                if any(abs(self.hits[p][c] / n - self.hits[q][c] / m) > limit for c in self.hits[p].keys() | self.hits[q].keys()):
                    return False
            todo += [(self.next[p][c], self.next[q][c]) for c in self.next[p].keys() & self.next[q].keys() if self.next[p][c] != self.next[q][c]]
        return True

    def _merge(self, p: int, q: int) -> None:
        """Folds the tree below q into p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            self.hits[p].update(self.hits[q])
            for c, to in self.next[q].items():
                if c in self.next[p]:
                    if self.next[p][c] != to:
                        todo.append((self.next[p][c], to))
                else:
                    self.next[p][c] = to

    def _fold(self) -> None:
        red, blue = [0], sorted((self.next[0][c], 0, c) for c in self.next[0])
        while blue:
            q, before, c = blue.pop(0)
            for p in red:
                if self._alike(p, q):
                    self.next[before][c] = p
                    self._merge(p, q)
                    break
            else:
                red.append(q)
            done = set(red)
            blue = sorted({(to, r, s) for r in red for s, to in self.next[r].items() if to not in done})
        self.states = red

    def _weigh(self) -> None:
        self.log: dict[int, dict[str, float]] = {}
        self.rest: dict[int, float] = {}
        self.log_end: dict[int, float] = {}
        for q in self.states:
            n = self._total(q) + 0.1 * (ALPHABET + 1)
            self.log[q] = {c: math.log((k + 0.1) / n) for c, k in self.hits[q].items()}
            self.rest[q], self.log_end[q] = math.log(0.1 / n), math.log((self.ends[q] + 0.1) / n)

    def score(self, s: str) -> float:
        """The log likelihood of a string; where no transition goes on, it goes on from the start."""
        at, total = 0, 0.0
        for c in s:
            total += self.log[at].get(c, self.rest[at])
            at = self.next[at].get(c, 0)
        return total + self.log_end[at]


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def fit(df: DataFrame, most_values: int = 400, most_symbols: int = 200_000) -> dict[str, Automaton]:
    """Automata by kind, and "ordinary" for the background.

    The base patterns label credentials in all texts.  An automaton is learned from a bounded sample of them:
    the ``most_values`` distinct values of its kind that are smallest by hash, as far as they have ``most_symbols``
    characters in all.  Each task hands on only what its own texts could add to that.  The background is
    sampled alike from all ordinary words, those outside base spans.  A kind without values has no automaton.
    """
    rows = pick(df, "doc_id", "text").where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, int]] = {k: {} for k in (*KINDS[:3], "ordinary")}

        def add(kind: str, values: Iterator[str]) -> None:
            mine = kept[kind]
            mine.update((v, _hash(v)) for v in values if v not in mine)
            if len(mine) > 4 * most_values:
                kept[kind] = dict(sorted(mine.items(), key=lambda x: (x[1], x[0]))[:most_values])

        for b in batches:
            for t in b.column(1):
                t = t.as_py()
                spans = base_spans(t)
                for _, _, kind, v in spans:
                    add(kind, iter((v,)))
                # Words end where a span begins.
                parts, done = [], 0
                for a, e, _, _ in spans:
                    parts.append(t[done:a])
                    done = max(done, e)
                t = "\0".join([*parts, t[done:]])
                add("ordinary", iter(set(ORDINARY.findall(t))))
        found = [(k, v, h) for k, mine in kept.items() for v, h in sorted(mine.items(), key=lambda x: (x[1], x[0]))[:most_values]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64()))], names=["kind", "value", "h"])

    # Small already, so distinct values of all tasks are kept and read once for each kind.
    values = cut(rows.mapInArrow(run, "kind string, value string, h bigint").distinct())
    out = {}
    for kind in (*KINDS[:3], "ordinary"):
        got, room = [], most_symbols
        for r in values.where(F.col("kind") == kind).orderBy("h", "value").limit(most_values).collect():
            if len(r.value) <= room:
                got.append(symbols(r.value))
                room -= len(r.value)
        if got:
            out[kind] = Automaton(got)
    return out


def plain_score(s: str) -> float:
    """The log likelihood of symbols as a number, signs between digits and all, or as a word of independent letters in one case
    or capitalised; else none."""
    n = len(s)
    if not s.strip("0-/_+="):
        signs = n - s.count("0")
        letters = signs * math.log(0.2 / 5) + (n - signs) * math.log(0.8)
    elif not s.strip("azAZ") and (s[1:] == s[1:].lower() or s == s.upper()):
        few = sum(c in "aA" for c in s)
        letters = few * math.log(6 / 26) + (n - few) * math.log(20 / 26)
    else:
        return -math.inf
    return letters + n * math.log(0.9) + math.log(0.1)


class Scanner:
    def __init__(self, automata: dict[str, Automaton], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.background = automata.get("ordinary")
        self.formats = [automata[k] for k in KINDS[:3] if k in automata]
        self.seen: dict[str, bool] = {}

    def is_secret(self, value: str) -> bool:
        s = symbols(value)
        if self.background is None or not self.formats:
            return False
        if s not in self.seen:
            if len(self.seen) > 30_000:
                self.seen.clear()
            gain = max(a.score(s) for a in self.formats) - max(self.background.score(s), plain_score(s))
            self.seen[s] = gain >= max(MARGIN, self.threshold * len(s))
        return self.seen[s]

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and all spans by start and kind.

        A candidate may overlap base spans, it then is scored whole; one that lies inside them adds nothing.
        """
        text = text or ""
        base = [(a, b, k) for a, b, k, _ in base_spans(text)]
        more, at, reach = [], 0, 0
        for m in CANDIDATE.finditer(text):
            # How far the base spans that begin at or before the candidate's start, or go on from there, reach without a gap.
            reach = max(reach, m.start())
            while at < len(base) and base[at][0] <= reach:
                reach = max(reach, base[at][1])
                at += 1
            if reach < m.end() and self.is_secret(m[0]):
                more.append((m.start(), m.end(), KINDS[3]))
        return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(df: DataFrame, automata: dict[str, Automaton], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points), one row for each row; null texts are empty."""
    scanner = shared(df, automata, Scanner)

    def start():
        s = scanner()

        def f(keys: list, texts: list) -> list[tuple]:
            named = [s.spans(t) for t in texts]
            return [(k, *([{"kind": x, "start": a, "end": b} for a, b, x in part] for part in both)) for k, both in zip(keys, named)]

        return f

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    return map_rows(pick(df, key, text), f"doc_id {dict(df.dtypes)[key]}, base {span}, spans {span}", start)


def redact(df: DataFrame, automata: dict[str, Automaton], mark: str = "[secret]") -> DataFrame:
    """The rows, with all their columns, each secret in text replaced by a mark; n_chars follows where it is a column.

    Spans that overlap give way to one mark.  Null texts stay null, and a text without secrets stays as it is.  Repeated rows
    each come back; an empty table stays empty; other columns, even ones whose names differ only in case, aren't touched.
    """
    scanner = shared(df, automata, Scanner)
    at, count = df.columns.index("text"), df.columns.index("n_chars") if "n_chars" in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in batches:
            texts, columns = [], list(b.columns)
            for x in b.column(at):
                t = x.as_py()
                parts, done = [], 0
                for a, e, _ in s.spans(t)[1]:
                    if a >= done:
                        parts += [t[done:a], mark]
                    done = max(done, e)
                texts.append("".join([*parts, t[done:]]) if done else t)
            changed = [x is not None and x != y.as_py() for x, y in zip(texts, b.column(at))]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array([len(t) if c else n.as_py() for t, c, n in zip(texts, changed, b.column(count))], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
        trim()

    small_batches(df.sparkSession)
    rows = plain(df)
    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)
