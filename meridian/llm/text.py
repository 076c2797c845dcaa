"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows whose Python values a task holds at once.
SLICE = 500


def utf8(texts: Iterable[str | None]) -> list[bytes]:
    """The texts as UTF-8; a null is empty, a lone surrogate becomes '?'."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that their order says nothing about how they were made."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of each run of k word hashes, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(out)


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """For each window of w grams, the place of its least gram (the rightmost of equals)."""
    if len(grams) < w:
        return np.empty(0, np.int64)
    best, at, size = grams, np.arange(len(grams)), 1
    while size < w:  # from windows of `size` to twice that, or to w
        step = min(size, w - size)
        left, right = best[: len(best) - step], best[step:]
        keep = left < right
        best, at = np.where(keep, left, right), np.where(keep, at[:-step], at[step:])
        size += step
    return at


def sliced(frames: Iterator[pd.DataFrame], rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """The frames in parts of at most `rows` rows, so that what is made of them stays small; an empty frame gives none."""
    for f in frames:
        for i in range(0, len(f), rows):
            yield f.iloc[i : i + rows]


def sorted_runs(frames: Iterator[pd.DataFrame], key: str, rows: int) -> Iterator[pd.DataFrame]:
    """Regroup the frames of a partition sorted by `key`: at least `rows` rows each, and no key in two of them."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        held.append(f)
        if sum(map(len, held)) < rows:
            continue
        f = pd.concat(held, ignore_index=True)
        last = (f[key] == f[key].iloc[-1]).to_numpy()
        cut = int(np.argmax(last))
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
            f = f.iloc[cut:].reset_index(drop=True)
        held = [f]
    if held:
        yield pd.concat(held, ignore_index=True)


def local_components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Label 0..n-1 by the least member reachable over pairs (a, b) and over what `label` already joins."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def append_columns(df: DataFrame, inputs: list[str], f: Callable[..., dict[str, list]], added: str) -> DataFrame:
    """`df` with the columns `added` (DDL), which `f` makes from the lists of values of `inputs`.

    The other columns pass as Arrow arrays, unread. Columns of `df` named like an added
    one are replaced; inputs that start with two underscores are dropped.
    """
    new = T.StructType.fromDDL(added)
    kept = [c for c in df.columns if c not in new.names and not (c in inputs and c.startswith("__"))]
    schema = T.StructType([df.schema[c] for c in kept] + new.fields)
    sent = df.select(*dict.fromkeys(kept + inputs))
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                got = f(*[b.column(c).to_pylist() for c in inputs])
                arrays = [b.column(c) for c in kept] + [pa.array(got[x.name], type=x.type) for x in arrow]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return sent.mapInArrow(run, schema)
