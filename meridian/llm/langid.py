"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed letter n-grams (1 to 3). Each
language has several centroids, found by spherical k-means over its training vectors.
The prediction is the language of the centroid with the largest cosine; a text whose
distance to every centroid is out of proportion to the training texts' is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from meridian.llm.text import append_columns

SPACE = 1 << 13
#: Training texts of a language, about; all languages together give at most LANGS times as many.
PER_LANG = 400
LANGS = 200
CENTROIDS = 4
#: A text is rejected if its cosine is below this part of what a text of its length should reach.
SLACK = 0.5

_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _is_letter


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the letter n-grams of a whole text; empty without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0)
    c = np.where(letter, c, np.uint64(32))
    c = np.r_[np.uint64(32), c, np.uint64(32)]
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    keys = np.concatenate([c, two, three]) * np.uint64(0x9E3779B97F4A7C15)
    count = np.bincount((keys >> np.uint64(64 - 13)).astype(np.int64), minlength=SPACE)
    slots = np.flatnonzero(count)
    return slots, count[slots]


@dataclass(frozen=True)
class Centroids:
    langs: list[str]
    of: np.ndarray
    idf: np.ndarray
    matrix: np.ndarray
    #: cosine that a training text reaches by log2 of its distinct n-grams (5th percentile, filled up)
    usual: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        slots, count = grams(text)
        if not len(slots):
            return "und", 0.0, True
        v = np.log1p(count) * self.idf[slots]
        cos = self.matrix[:, slots] @ v / max(np.linalg.norm(v), 1e-12)
        best = int(np.argmax(cos))
        usual = self.usual[min(len(self.usual) - 1, len(slots).bit_length())]
        return self.langs[self.of[best]], float(min(1.0, max(0.0, cos[best]))), bool(cos[best] < SLACK * usual)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from spread-out rows, so it needs no seed."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, axis=1))])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, per_lang: int = PER_LANG, centroids: int = CENTROIDS) -> Centroids:
    """Fit on a sample of the rows of `docs` (doc_id, text, lang) that have a text and a lang.

    The sample takes about `per_lang` rows of each of the LANGS most frequent languages (of
    equally frequent ones the first by name), chosen by a hash of doc_id, so its size does not follow the corpus.
    Repeated rows count as often as they come up. Rows that lack doc_id, text or lang, and texts without a letter,
    teach nothing; an empty table gives a model without languages, which rejects everything.
    """
    docs = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not counts:
        return Centroids([], np.empty(0, int), np.ones(SPACE), np.empty((0, SPACE)), np.zeros(1))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))])
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "doc_id"), 11) / F.lit(float(1 << 53))
    sample = docs.where(unit < F.element_at(share, F.col("lang")))

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [grams(t) for t in f["text"]]
            yield pd.DataFrame(
                {"doc_id": f["doc_id"], "lang": f["lang"], "slots": [s.astype(np.uint16).tobytes() for s, _ in got], "counts": [c.astype(np.float32).tobytes() for _, c in got]}
            )

    rows = sample.mapInPandas(vectors, "doc_id long, lang string, slots binary, counts binary").toPandas()
    rows = rows[rows["slots"].str.len() > 0].sort_values("doc_id", ignore_index=True)
    x, size = np.zeros((len(rows), SPACE), np.float32), np.zeros(len(rows), int)
    for i, (s, c) in enumerate(zip(rows["slots"], rows["counts"])):
        slots = np.frombuffer(s, np.uint16)
        x[i, slots], size[i] = np.log1p(np.frombuffer(c, np.float32)), len(slots)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    langs, parts, of = sorted(set(rows["lang"])), [], []
    for j, lang in enumerate(langs):
        c = _kmeans(x[(rows["lang"] == lang).to_numpy()], centroids)
        parts.append(c)
        of += [j] * len(c)
    matrix = np.concatenate(parts) if parts else np.empty((0, SPACE), np.float32)
    best = (x @ matrix.T).max(axis=1) if len(parts) else np.empty(0)
    bits = np.array([int(s).bit_length() for s in size])
    found = {b: np.quantile(best[bits == b], 0.05) for b in set(bits.tolist()) if (bits == b).sum() >= 20}
    # a short text's cosine falls with the root of its length; lengths without enough examples follow that from the shortest with
    shortest, low = min(found, default=0), min(found.values(), default=0.0)
    usual = np.array([found.get(b, low * 2.0 ** min(0.0, (b - shortest) / 2)) for b in range(15)])
    return Centroids(langs, np.array(of, int), idf, matrix.astype(np.float64), usual)


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """`docs` with lang_pred, score (cosine, 0 to 1) and rejected.

    A null text or one without a letter is `und`, score 0, rejected; so is every text if
    the model learned nothing. Equal cosines go to the first language by name. Columns of
    `docs` named like an added one are replaced. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> dict[str, list]:
        m = shared.value
        got = [m.nearest(t) if len(m.langs) else ("und", 0.0, True) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

    return append_columns(docs, ["text"], run, "lang_pred string, score double, rejected boolean")
