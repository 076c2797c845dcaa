"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Cyclic boosting visits the features in turn and
fits a shallow tree (a few cuts of one feature's bins) to what is left of the logistic
loss; the trees of a feature add up to its lookup table. Then the pairs of features with
the most left to explain get tables of their own, by trees that cut both features. A score
is the sum of the entries that a text's bins point at, for whole batches at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from meridian.llm.text import append_columns

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
BINS = 32
ROUNDS, RATE = 120, 0.15
PAIRS, PAIR_ROUNDS = 6, 40
#: Cuts of one tree, least weight of a leaf, and the pull towards zero.
CUTS, LEAF, RIDGE = 3, 8.0, 1.0

FEATURES = [
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "points", "odd_marks", "odd_words",
    "distinct_words", "repeated_words", "repeated_lines", "line_length", "entropy", "short_words", "longest_word",
]
_ODD = re.compile(r"[^\w.,;:?'\"()-]")


def features(text: str | None) -> list[float]:
    """Figures of a whole text, in the order of FEATURES; a null text counts as empty."""
    text = text or ""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    part = counts[counts > 0] / max(1, len(raw))
    upper = sum(map(str.isupper, words))
    lengths = list(map(len, words))
    lines = text.split("\n")
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum()
    points = sum(counts[ord(c)] for c in ".,;:?'\"()-")
    odd = sum(counts[ord(c)] for c in "!#$%&*+/<=>@[\\]^_`{|}~")
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(lengths) / m, letters / n, upper / m,
        counts[48:58].sum() / n, points / n, odd / n, sum(map(bool, map(_ODD.search, words))) / m if odd else 0.0,
        len(set(words)) / m, sum(map(str.__eq__, words, words[1:])) / m, 1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))), float(-(part * np.log2(part)).sum()), sum(x <= 3 for x in lengths) / m, float(np.log1p(max(lengths, default=0))),
    ]


@dataclass(frozen=True)
class Additive:
    """Lookup tables: `cuts` bin the features, `base` is the log odds of no information."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.empty((0, len(self.cuts)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        b = self.bins(x)
        odds = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            odds += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            odds += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-odds))


def _leaf(g: float | np.ndarray, h: float | np.ndarray) -> float | np.ndarray:
    return g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, cuts: int) -> np.ndarray:
    """Values by bin of a tree with up to `cuts` cuts, from gradient and curvature sums by bin."""
    parts = [(0, len(g))]
    gs, hs = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(cuts):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            gl, hl = gs[at] - gs[a], hs[at] - hs[a]
            gr, hr = gs[b] - gs[at], hs[b] - hs[at]
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + RIDGE)
            gain[(hl < LEAF / 4) | (hr < LEAF / 4)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), k, int(at[gain.argmax()]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(gs[b] - gs[a], hs[b] - hs[a])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best tree that cuts the first feature once and each side's second feature once, and its gain."""
    best, out = 0.0, np.zeros_like(g)
    gc, hc = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    for a in range(1, len(g)):
        value, total = np.zeros_like(g), 0.0
        for rows, gg, hh in ((slice(0, a), gc[a - 1], hc[a - 1]), (slice(a, None), gc[-1] - gc[a - 1], hc[-1] - hc[a - 1])):
            leaf = _tree(gg, hh, 1)
            total += float((leaf * gg).sum())
            value[rows] = leaf
        if total > best:
            best, out = total, value
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit on features and labels (0 or 1). Without both labels the tables stay empty."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(len(FEATURES))]
    mean = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base = float(np.log(mean / (1 - mean)))
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = Additive(cuts, base, tables, [], [])
    if len(set(y.tolist())) < 2:
        return model
    b, odds = model.bins(x), np.full(len(x), base)

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(ROUNDS):
        for j, t in enumerate(tables):
            step = RATE * _tree(*sums(b[:, j], len(t)), CUTS)
            t += step
            odds += step[b[:, j]]
    grids = {}
    for i, j in combinations(range(len(cuts)), 2):
        shape = (len(tables[i]), len(tables[j]))
        g, h = (v.reshape(shape) for v in sums(b[:, i] * shape[1] + b[:, j], shape[0] * shape[1]))
        grids[i, j] = _pair_tree(g, h)[1]
    pairs = sorted(grids, key=lambda k: (-grids[k], k))[:PAIRS]
    pair_tables = [np.zeros((len(tables[i]), len(tables[j]))) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(pairs, pair_tables):
            g, h = (v.reshape(t.shape) for v in sums(b[:, i] * t.shape[1] + b[:, j], t.size))
            step = RATE * _pair_tree(g, h)[0]
            t += step
            odds += step[b[:, i], b[:, j]]
    return Additive(cuts, base, tables, pairs, pair_tables)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Fit on the labelled documents: at most `sample` labels, the first by a hash of doc_id.

    `labels` has doc_id and label (0 or 1); rows with a null in either are passed over, and
    a document's repeated labels count once, as the smallest. A null text is learned from as an empty one, and rows that
    repeat a labelled doc_id as documents of that label. Without labels the model gives 0.5 to all.
    """
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = labels.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` pairs of numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "label": f["label"], "x": [features(t) for t in f["text"]]})

    got = rows.mapInPandas(run, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", ignore_index=True)
    x = np.stack(got["x"]) if len(got) else np.empty((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy(float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """`docs` with score, the probability of label 1.

    A null text scores like an empty one. A model without labels gives 0.5 to all. Columns
    of `docs` named score are replaced. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> dict[str, list]:
        x = np.array([features(t) for t in texts]) if texts else np.empty((0, len(FEATURES)))
        return {"score": shared.value.score(x).tolist()}

    return append_columns(docs, ["text"], run, "score double")
