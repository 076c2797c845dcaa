"""Substring dedup over FM-indexes.

1. Winnowing picks in every window of `window` words the least `gram`-word hash as its
   anchor. Equal windows have equal anchors, so a window whose anchor occurs once in the
   corpus is not repeated. Only hashes are shuffled to find the anchors that repeat.
2. The words around such an anchor that its windows span are its context. Equal contexts
   are merged to their earliest place before they are shuffled any further.
3. Contexts are dealt by anchor into shards. Each shard has a compressed FM-index (bit-packed
   wavelet tree of the transform, laid out by level) through which the contexts are streamed.
   Backward search gives the matching statistics, up to the threshold of `window` words: how
   many words up to a place also stand elsewhere. Where they reach the threshold, the least
   origin of the interval of suffixes is the window's first occurrence.
4. Each document takes the windows that first occurred earlier as intervals to remove.

Streaming whole documents past every shard would take time in proportion to documents times
shards; anchors send each passage to the one shard where its copies are. An anchor with more
different contexts than one index holds (the edges of a very common passage) would make a
task grow with the corpus. Such contexts are cut into single windows, which are grouped by
content with the least place kept at every step; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from meridian.llm.text import append_columns, gram_hashes, sliced, sorted_runs, utf8, window_minima
from meridian.plans.scratch import Scratch

WINDOW = 20
GRAM = 5
#: Contexts of one index.
SHARD = 10_000
#: Windows searched together.
BLOCK = 100_000


class FMIndex:
    """Backward search over integer sequences (symbols from 1; 0 ends a sequence)."""

    def __init__(self, text: np.ndarray, depth: int):
        """`text` ends with 0; suffixes are sorted by their first `depth` symbols or more."""
        n = len(text)
        rank, k = text.astype(np.int64), 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - k] = rank[k:] + 1
            key = rank * (n + 2) + second
            sa = np.argsort(key)
            new = np.r_[False, np.diff(key[sa]) != 0]
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(new)
            k *= 2
            if k >= depth or rank[sa[-1]] == n - 1:
                break
        self.sa = sa.astype(np.int32 if n < 1 << 31 else np.int64)
        last = text[sa - 1]
        sigma = int(text.max()) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.levels = max(1, (sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = ((last >> level) & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(64 - n % 64, bool)], bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.r_[0, np.cumsum(np.bitwise_count(packed).astype(np.int64))])
            self.zeros.append(n - int(bit.sum()))
            last = np.r_[last[~bit], last[bit]]
        symbols = np.arange(sigma)
        self.first = self._down(symbols, np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for t, level in enumerate(reversed(range(self.levels))):
            at, low = i >> 6, (i & 63).astype(np.uint64)
            ones = self.ones[t][at] + np.bitwise_count(self.words[t][at] & ((np.uint64(1) << low) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, self.zeros[t] + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with `symbol` and go on in [lo, hi)."""
        base = self.before[symbol] - self.first[symbol]
        return base + self._down(symbol, lo), base + self._down(symbol, hi)


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of `ends`, how many symbols up to it also stand elsewhere in the index, `most` at most, and the suffixes that start so.

    `text` is what the index is of. The interval [lo, hi) is that of the match where it
    reached `most` symbols, else empty.
    """
    stat, first, last = (np.zeros(len(ends), np.int64) for _ in range(3))
    active = np.arange(len(ends))
    lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(text))
    for step in range(most):
        lo, hi = index.extend(text[ends[active] - step], lo, hi)
        go = hi - lo > 1
        active, lo, hi = active[go], lo[go], hi[go]
        stat[active] = step + 1
    first[active], last[active] = lo, hi
    return stat, first, last


def first_occurrences(f: pd.DataFrame, window: int) -> pd.DataFrame:
    """For each context (ctx, text, n, doc_id, start) of a shard, where each of its n windows first occurs."""
    ids: dict[bytes, int] = {}
    words = [t.split(b" ") for t in f["text"]]
    lengths = np.array([len(w) for w in words])
    text = np.zeros(int(lengths.sum()) + len(words), np.int64)
    begin = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    text[np.arange(lengths.sum()) + np.repeat(np.arange(len(words)), lengths)] = [ids.setdefault(x, len(ids) + 1) for w in words for x in w]
    index = FMIndex(text, window + 1)
    of = np.repeat(np.arange(len(words)), lengths + 1)
    doc = f["doc_id"].to_numpy()[of]
    at = f["start"].to_numpy().astype(np.int64)[of] + np.arange(len(text)) - begin[of]
    order = np.lexsort((at, doc))
    place = np.empty(len(text), np.int64)
    place[order] = np.arange(len(text))
    in_suffix_order = np.r_[place[index.sa], 0]
    n = f["n"].to_numpy()
    starts = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    least = place[starts]
    for i in range(0, len(starts), BLOCK):
        stat, lo, hi = matching_statistics(index, text, starts[i : i + BLOCK] + window - 1, window)
        hit = np.flatnonzero(stat >= window)
        if len(hit):
            low, which = np.unique(lo[hit], return_inverse=True)
            high = np.empty(len(low), np.int64)
            high[which] = hi[hit]
            least[i + hit] = np.minimum.reduceat(in_suffix_order, np.c_[low, high].ravel())[::2][which]
    source = order[least]
    cut = np.cumsum(n)[:-1]
    return pd.DataFrame({"ctx": f["ctx"], "docs": np.split(doc[source], cut), "starts": np.split(at[source], cut)})


def _anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor's hash, anchor's place) of each window."""
    grams = gram_hashes(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), gram)
    at = window_minima(grams, window - gram + 1)
    return grams[at].view(np.int64), at


def _bases(docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(doc_id, v, base) of the rows that share a doc_id with another text: v is a hash of the text, base where its words are counted from."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("v"), F.length("text").cast("long").alias("size"))
    several = marked.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("doc_id")
    several = scratch.write(several)
    if several.isEmpty():
        return None
    before = Window.partitionBy("doc_id").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    texts = marked.join(several, "doc_id", "left_semi").distinct()
    return scratch.write(texts.select("doc_id", "v", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")))


def _based(docs: DataFrame, bases: DataFrame | None) -> DataFrame:
    """`docs` with base."""
    if bases is None:
        return docs.withColumn("__base", F.lit(0).cast("long"))
    bases = bases.select(F.col("doc_id").alias("__d"), F.col("v").alias("__v"), F.col("base").alias("__b"))
    joined = docs.join(bases, (F.col("doc_id") == F.col("__d")) & (F.xxhash64("text") == F.col("__v")), "left")
    return joined.withColumn("__base", F.coalesce("__b", F.lit(0))).drop("__d", "__v", "__b")


def _removals(docs: DataFrame, window: int, gram: int, most: int, bases: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(doc_id, starts): the starts, in words from the text's base, of the windows whose words also start earlier.

    Earlier: in a document with a smaller doc_id, or before in the same one. Documents
    without such a window have no row.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in sliced(frames):
            ids, fps, many = [], [], []
            for i, t in zip(f["doc_id"], utf8(f["text"])):
                fp, at = _anchors(t.split(), window, gram)
                fp, count = np.unique(fp[np.r_[True, np.diff(at) != 0]] if len(at) else fp, return_counts=True)
                ids.append(np.full(len(fp), i))
                fps.append(fp)
                many.append(count)
            yield pd.DataFrame({"doc_id": np.concatenate(ids), "fp": np.concatenate(fps), "many": np.concatenate(many)})

    found = scratch.write(docs.mapInPandas(anchors, "doc_id long, fp long, many int"))
    repeated = scratch.write(found.groupBy("fp").agg(F.sum("many").alias("many")).where("many > 1").select("fp"))
    of_doc = found.join(repeated, "fp", "left_semi").groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in sliced(frames):
            rows = []
            for i, t, known, base in zip(f["doc_id"], utf8(f["text"]), f["fps"], f["__base"]):
                words = t.split()
                fp, at = _anchors(words, window, gram)
                first = np.flatnonzero(np.r_[True, np.diff(at) != 0])
                n = np.diff(np.r_[first, len(at)])
                hot = np.isin(fp[first], known)
                for s, k, a in zip(first[hot].tolist(), n[hot].tolist(), fp[first[hot]].tolist()):
                    part = b" ".join(words[s : s + k + window - 1])
                    rows.append((i, base + s, k, a, xxh3_128_digest(part), part))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "n", "fp", "ctx", "text"])

    seen = _based(docs, bases).join(of_doc, "doc_id").mapInPandas(contexts, "doc_id long, start long, n int, fp long, ctx binary, text binary")
    seen = scratch.write(seen)
    scratch.free(found, repeated)

    first = F.min(F.struct("doc_id", "start", "n", "fp", "text")).alias("c")
    distinct = scratch.write(seen.groupBy("ctx").agg(first).select("ctx", "c.*"))
    common = scratch.write(distinct.groupBy("fp").count().where(F.col("count") > most).select("fp"))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in sorted_runs(frames, "fp", SHARD):
            yield first_occurrences(f, window)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = distinct.join(common, "fp", "left_anti").repartition(n, "fp").sortWithinPartitions("fp")
    searched = shards.mapInPandas(search, "ctx binary, docs array<long>, starts array<long>")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c, t, k, d, s in zip(f["ctx"], f["text"], f["n"], f["doc_id"], f["start"]):
                words = t.split(b" ")
                rows += [(c, j, d, s + j, xxh3_128_digest(b" ".join(words[j : j + window]))) for j in range(k)]
            yield pd.DataFrame(rows, columns=["ctx", "j", "doc_id", "start", "words"])

    crowded = distinct.join(common, "fp", "left_semi")
    single = scratch.write(crowded.mapInPandas(cut, "ctx binary, j int, doc_id long, start long, words binary"))
    least = scratch.write(single.groupBy("words").agg(F.min(F.struct("doc_id", "start")).alias("least")))
    grouped = single.join(least, "words").groupBy("ctx").agg(F.sort_array(F.collect_list(F.struct("j", "least"))).alias("w"))
    grouped = grouped.select("ctx", F.col("w.least.doc_id").alias("docs"), F.col("w.least.start").alias("starts"))

    verdict = scratch.write(searched.unionByName(grouped))
    earlier = F.expr(
        "transform(filter(sequence(0, n - 1), i -> docs[i] < doc_id or (docs[i] = doc_id and starts[i] < start + i)), i -> start + i)"
    )
    hits = seen.select("doc_id", "start", "n", "ctx").join(verdict, "ctx").select("doc_id", earlier.alias("hits")).where("size(hits) > 0")
    out = scratch.write(hits.groupBy("doc_id").agg(F.flatten(F.collect_list("hits")).alias("starts")))
    scratch.free(seen, distinct, common, single, least, verdict)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = SHARD) -> DataFrame:
    """`docs` with n_words, n_removed, removed (array of [from, to) word spans) and kept.

    Words are runs of bytes other than ASCII white space. A word goes if a window of
    `window` words that covers it also starts earlier (smaller doc_id, or before in the
    same document); windows are judged on the input. kept joins the other words by one
    space. Null texts have no words; a null doc_id takes no part and keeps all. Rows of one
    doc_id with different texts are one document of several texts, in the order of a hash, and
    no window goes from one into another; rows that repeat both get equal results. Columns of
    `docs` named like an added one are replaced, others pass through. An empty table gives an
    empty result. `most` contexts of one anchor fit an index; it decides no result.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("__starts", "__base", "__b", "__d", "__v")
    bases = _bases(docs.where("doc_id is not null and text is not null"), scratch)
    removals = _removals(docs, window, gram, most, bases, scratch).withColumnRenamed("starts", "__starts")
    joined = _based(docs, bases).join(removals, "doc_id", "left")

    def apply(texts: list[str | None], removed: list[list[int] | None], bases: list[int]) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "removed": [], "kept": []}
        for t, starts, base in zip(utf8(texts), removed, bases):
            words, spans = t.split(), []
            n = len(words)
            s = np.unique(starts or []) - base
            s = s[(s >= 0) & (s + window <= n)].astype(np.int64)
            if len(s):
                spans = [[int(p[0]), int(p[-1]) + window] for p in np.split(s, np.flatnonzero(np.diff(s) > window) + 1)]
                for a, b in reversed(spans):
                    del words[a:b]
            for k, v in zip(out, (n, n - len(words), spans, b" ".join(words).decode("utf-8", "replace"))):
                out[k].append(v)
        return out

    return append_columns(joined, ["text", "__starts", "__base"], apply, "n_words long, n_removed long, removed array<array<int>>, kept string")
