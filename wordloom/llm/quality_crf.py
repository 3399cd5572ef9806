"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad from features of itself and of its neighbours; transition weights tie neighbouring
labels.  Training sees documents' labels only, so every line of a labelled document carries its label.  A document's
lines get forward-backward marginals; their mean, weighted by line length, goes through a logistic calibration, which
gives the score.

Fitting reads a bounded sample: about ``most`` labelled documents by a hash of their key, and of all runs of RUN lines in
them about ``most_runs``, by a hash of key and run, which bounds the driver's memory.  The calibration is fitted on the
same documents' whole texts, each counting once.  Scoring reads whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut, map_rows, pick, shared
from wordloom.llm.spotsigs import COMMON

WORD = re.compile(r"[^\W_]+")
#: Lines of one run in training.
RUN = 64
#: Fixed cut points of the features that are fractions, and of the others in order.
CUTS = {
    "upper": (0.1, 0.3, 0.6), "symbol": (0.02, 0.08, 0.2), "digit": (0.05, 0.15, 0.4), "bar": (0.005, 0.02, 0.1), "shout": (0.005, 0.02, 0.1),
    "common": (0.05, 0.15, 0.3), "word_length": (0.3, 0.5, 0.8), "varied": (0.3, 0.6, 0.9), "marked": (0.1, 0.3, 0.6), "twice": (0.05, 0.2, 0.5),
    "words": (0.15, 0.3, 0.5), "longest": (0.2, 0.4, 0.8),
}
FLAGS = ("ends", "starts", "seen", "blank")
WIDTH = 4 * len(CUTS) + len(FLAGS)


def _classes() -> np.ndarray:
    """Classes of the first 0x250 code points and, last, of all others: 0 other, 1 upper, 2 letter, 3 digit, 4 space, 5 plain sign, 6 bar, 7 shout."""
    out = []
    for c in map(chr, range(0x250)):
        out.append(6 if c == "|" else 7 if c == "!" else 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:'\"?()-" else 0)
    return np.array([*out, 2])


_CLASSES = _classes()


def line_features(line: str, seen: bool) -> np.ndarray:
    x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    other, upper, letter, digit, space, sign, bar, shout = np.bincount(_CLASSES[np.minimum(x, 0x250)], minlength=8).tolist()
    n, letters = max(1, len(x) - space), max(1, upper + letter)
    words = WORD.findall(line.lower())
    parts = line.split()
    k = max(1, len(words))
    pairs = list(zip(words, words[1:]))
    values = (
        upper / letters, (other + bar + shout) / n, digit / n, bar / n, shout / n, sum(w in COMMON for w in words) / k, letters / k / 10, len(set(words)) / k,
        sum(not p[-1].isalnum() for p in parts) / max(1, len(parts)), 1 - len(set(pairs)) / max(1, len(pairs)) if pairs else 0.0, math.log1p(len(words)) / 8, max(map(len, words), default=0) / 40,
    )
    out = np.zeros(WIDTH, np.float32)
    for i, (v, cuts) in enumerate(zip(values, CUTS.values())):
        out[4 * i] = min(v, 2.0)
        for j, c in enumerate(cuts):
            out[4 * i + 1 + j] = v > c
    s = line.strip()
    out[4 * len(CUTS):] = s[-1:] in (".", "!", "?", '"', "”"), s[:1].isupper(), seen, not s
    return out


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line, with those of the lines before and after, and the lines' weights."""
    lines = (text or "").split("\n")
    own = np.empty((len(lines), WIDTH), np.float32)
    for i, (line, again) in enumerate(zip(lines, _repeated(lines))):
        own[i] = line_features(line, again)
    return with_neighbours(own), np.array([len(x) + 1 for x in lines], float)


def _repeated(lines: list[str]) -> np.ndarray:
    """Whether each line isn't blank and came before."""
    seen: set[str] = set()
    return np.fromiter((bool(x.strip()) and x in seen or seen.add(x) is not None for x in lines), bool, len(lines))


def _window(lines: list[str], again: np.ndarray, begin: int, size: int) -> np.ndarray:
    """The features of ``size`` lines from ``begin`` on, as they are in the whole text: one line more on either side is looked at."""
    low, high = max(0, begin - 1), min(len(lines), begin + size + 1)
    x = with_neighbours(np.stack([line_features(lines[j], again[j]) for j in range(low, high)]))
    # Edges are the text's own, not those of the stretch.
    x[0, -3], x[-1, -2] = low == 0, high == len(lines)
    return x[begin - low:begin - low + size]


def chosen_runs(text: str | None, chosen: Callable[[int], bool]) -> Iterator[np.ndarray]:
    """The features of a text's runs of RUN lines, of those only that are chosen by number."""
    lines = (text or "").split("\n")
    wanted = [i for i in range(-(-len(lines) // RUN)) if chosen(i)]
    again = _repeated(lines) if wanted else []
    for i in wanted:
        yield _window(lines, again, i * RUN, RUN)


def line_scores(text: str | None, weights: np.ndarray, size: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Each line's features times ``weights``, and the lines' weights; features are made and dropped in windows of lines."""
    lines = (text or "").split("\n")
    again = _repeated(lines)
    out = np.empty(len(lines))
    for begin in range(0, len(lines), size):
        out[begin:begin + size] = _window(lines, again, begin, size) @ weights
    return out, np.fromiter((len(x) + 1 for x in lines), float, len(lines))


def with_neighbours(own: np.ndarray) -> np.ndarray:
    none = np.zeros((1, own.shape[1]), own.dtype)
    edge = np.zeros((len(own), 2), own.dtype)
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), edge, np.ones((len(own), 1), own.dtype)])


FEATURES = 3 * WIDTH + 3


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(score: np.ndarray, trans: np.ndarray, run: int = 4096) -> np.ndarray:
    """The probability of label 1 of each line; score (lines, 2), trans (2, 2), log domain.  Scaled forward and backward passes.

    A long text's numbers are held as arrays, and ``run`` lines at a time as Python's.
    """
    t = len(score)
    (a, b), (c, d) = np.exp(trans - trans.max()).tolist()
    ahead, out = np.empty((t, 2)), np.empty(t)
    top = score.max(axis=1)
    p = q = None
    for low in range(0, t, run):
        part = []
        for x, y in np.exp(score[low:low + run] - top[low:low + run, None]).tolist():
            p, q = (x, y) if p is None else ((p * a + q * c) * x, (p * b + q * d) * y)
            s = p + q
            p, q = p / s, q / s
            part.append((p, q))
        ahead[low:low + run] = part
    p = q = 1.0
    for low in range((t - 1) // run * run, -1, -run):
        part = []
        for (f, g), (x, y) in zip(reversed(ahead[low:low + run].tolist()), reversed(np.exp(score[low:low + run] - top[low:low + run, None]).tolist())):
            u, v = f * p, g * q
            part.append(v / (u + v))
            p, q = p * x, q * y
            p, q = a * p + b * q, c * p + d * q
            s = p + q
            p, q = p / s, q / s
        out[low:low + run] = part[::-1]
    return out


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, slope: float, offset: float) -> None:
        self.weights, self.trans, self.slope, self.offset = weights, trans, slope, offset

    def line_marginals(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The probability that each line is good, and the lines' weights."""
        s, w = line_scores(text, self.weights)
        return marginals(np.stack([np.zeros(len(s)), s], axis=1), self.trans), w

    def evidence(self, text: str | None) -> tuple[float, int]:
        """The log odds of the lines' mean marginal, weighted by length, and the number of bad lines."""
        p, w = self.line_marginals(text)
        return _logit(float((p * w).sum() / w.sum())), int((p < 0.5).sum())

    def calibrated(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-self.slope * evidence - self.offset))

    def score(self, text: str | None) -> float:
        return self.calibrated(self.evidence(text)[0])


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def train(runs: list[np.ndarray], labels: list[int], rounds: int = 200, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (of label 1 over label 0) and transitions that make the labels likeliest, by Adam on the whole sample."""
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
    runs, y = [runs[i] for i in order], np.array([labels[i] for i in order])
    n, steps = len(runs), len(runs[0])
    x = np.zeros((n, steps, FEATURES), np.float32)
    mask = np.zeros((n, steps))
    for i, r in enumerate(runs):
        x[i, :len(r)], mask[i, :len(r)] = r, 1
    alive = [int(mask[:, t].sum()) for t in range(steps)]
    # Both labels weigh the same in all, as far as the labels' numbers differ.
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * n
    w, trans = np.zeros(FEATURES), np.zeros((2, 2))
    moments = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    for step in range(1, rounds + 1):
        s = np.stack([np.zeros((n, steps)), x @ w.astype(np.float32)], axis=2)
        f, b = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        f[:, 0] = s[:, 0]
        for t in range(1, steps):
            k = alive[t]
            f[:k, t] = _log_sum(f[:k, t - 1, :, None] + trans, 1) + s[:k, t]
        for t in range(steps - 2, -1, -1):
            k = alive[t + 1]
            b[:k, t] = _log_sum(trans + (s[:k, t + 1] + b[:k, t + 1])[:, None, :], 2)
        z = _log_sum(f[:, 0] + b[:, 0], 1)
        p1 = np.exp(f[..., 1] + b[..., 1] - z[:, None]) * mask
        weight = mask * share[:, None]
        grad = np.einsum("nt,ntf->f", ((y[:, None] - p1) * weight).astype(np.float32), x).astype(float)
        pair = np.zeros((2, 2))
        for t in range(1, steps):
            k = alive[t]
            joint = np.exp(f[:k, t - 1, :, None] + trans + (s[:k, t] + b[:k, t])[:, None, :] - z[:k, None, None])
            pair -= (joint * share[:k, None, None]).sum(axis=0)
        for v in (0, 1):
            pair[v, v] += (share * (mask.sum(axis=1) - 1))[y == v].sum()
        g = np.r_[grad - ridge * w, (pair - ridge * trans).ravel()] / n
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.05 * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:FEATURES], trans + move[FEATURES:].reshape(2, 2)
    return w, trans


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y), by Newton steps with a little ridge."""
    d = np.stack([x, np.ones(len(x))], axis=1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ c))
        h = (d * (p * (1 - p))[:, None]).T @ d + 0.1 * np.eye(2)
        c += np.linalg.solve(h, d.T @ (y - p) - 0.1 * c)
    return float(c[0]), float(c[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, most_runs: int = 4000) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, quality 0 or 1); rows without a label teach nothing.

    Without labels of both kinds every text gets the same score, the labels' smoothed share of 1, or 0.5.
    """
    named = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
    counts = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}
    if len(counts) < 2:
        ones = counts.get(1, 0)
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, _logit((ones + 1) / (sum(counts.values()) + 2)))
    share = min(1.0, most / sum(counts.values()))
    # About ``most`` rows: a table of bounded size.
    chosen = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    rows = cut(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"))
    in_all = rows.agg(F.sum(F.ceil((F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1) / RUN))).first()[0] or 1
    wanted = min(1.0, most_runs / in_all) * 2**64

    def start():
        def f(keys: list, labels_: list, texts: list) -> list[tuple]:
            return [(y, x.astype(np.float32).tobytes()) for k, y, t in zip(keys, labels_, texts) for x in chosen_runs(t, lambda i: xxhash.xxh64_intdigest(f"{k}:{i}") < wanted)]

        return f

    got = map_rows(rows, "label int, x binary", start).collect()
    got.sort(key=lambda r: (r.label, r.x))
    w, trans = train([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got], [r.label for r in got])
    model = Model(w, trans, 1.0, 0.0)
    kept = shared(docs, model, lambda m: m)

    def start_means():
        m = kept()
        return lambda keys, labels_, texts: [(y, m.evidence(t)[0]) for y, t in zip(labels_, texts)]

    means = map_rows(rows, "label int, evidence double", start_means).collect()
    means.sort()
    model.slope, model.offset = calibrate(np.array([r.evidence for r in means]), np.array([r.label for r in means], float))
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and n_bad_lines, one row for each row; null texts are empty, an empty text is one blank line.

    Texts are read whole whatever their length: of a very long one a few numbers a line are held and the features of one window of lines.
    """
    kept = shared(df, model, lambda m: m)

    def start():
        m = kept()

        def f(keys: list, texts: list) -> list[tuple]:
            found = [m.evidence(t) for t in texts]
            return [(k, m.calibrated(x), bad) for k, (x, bad) in zip(keys, found)]

        return f

    return map_rows(pick(df, key, text), f"doc_id {dict(df.dtypes)[key]}, score double, n_bad_lines bigint", start)
