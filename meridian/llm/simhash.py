"""SimHash near-dedup over BK-trees.

Distinct fingerprints are the nodes. Two fingerprints within `radius` bits agree on all but
`radius` of any disjoint bit blocks, so each shard (choice of blocks, their values) gets a
BK-tree of its own and every link lies whole within some shard. With more fingerprints the
bits are cut into more blocks, of which more have to agree, so shards stay small: one of 5
blocks, two of 6 or three of 7. A tree is not broadcast: its size follows the data, so tree
and queries are dealt to the same task. A shard with many fingerprints for all that is cut
into chunks, each pair of chunks a unit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from meridian.llm.text import append_columns, local_components, sorted_runs, utf8
from meridian.operators.graph import connected_components
from meridian.plans.scratch import Scratch

SHINGLE = 4
RADIUS = 4
#: Most fingerprints of one tree.
CHUNK = 2048
#: Pairs of query and tree node looked at together; bounds a task's memory.
PAIRS = 500_000


def majority(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of 64-bit hashes, as an array of one: a bit is 1 if over half of them have it."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Majority bits of the XXH64 (seed 42) of the lower-cased word shingles, as an array of one; 0 without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = list(accumulate(len(x) + 1 for x in words))
        starts = [0, *ends]
        parts = (joined[i : j - 1] for i, j in zip(starts, ends[shingle - 1 :]))
        hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(42)), np.uint64, len(words) - shingle + 1)
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprints as signed longs, of every row; null and empty texts have 0.

    Repeated rows give repeated results, a null doc_id stays null, and an empty table gives an empty one. Extra columns go.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        return {"fp": [fingerprint(t, shingle).view(np.int64)[0] for t in utf8(texts)]}

    return append_columns(docs.select("doc_id", F.col("text").alias("__text")), ["__text"], run, "fp long")


class BKForest:
    """BK-trees over the items of many shards at once, as arrays.

    The first item of a shard is its root. Below a node there is at most one child for
    each Hamming distance; `search` follows only the edges within the radius.
    """

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        n = len(fps)
        self.fps = fps
        new = np.r_[True, shard[1:] != shard[:-1]] if n else np.empty(0, bool)
        self.root_of_shard = np.flatnonzero(new)
        self.shard_no = np.cumsum(new) - 1
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        items = np.flatnonzero(~new)
        at = self.root_of_shard[self.shard_no[items]]
        while len(items):
            d = np.bitwise_count(fps[items] ^ fps[at]).astype(np.int64)
            slot = at * 65 + d
            order = np.argsort(slot, kind="stable")
            first = np.r_[True, np.diff(slot[order]) != 0]
            child_of_slot = items[order][first]
            parent[child_of_slot], edge[child_of_slot] = at[order][first], d[order][first]
            child = np.empty(len(items), np.int64)
            child[order] = child_of_slot[np.cumsum(first) - 1]
            down = child != items
            items, at = items[down], child[down]
        kids = np.flatnonzero(parent >= 0)
        slots = parent[kids] * 65 + edge[kids]
        order = np.argsort(slots)
        self.kids, self.slots = kids[order], slots[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, item) within the radius; each query starts at its own root."""
        found_q, found_i = [], []
        q, node = np.arange(len(queries)), roots
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_i.append(node[hit])
            lo = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), side="right")
            many = hi - lo
            q = np.repeat(q, many)
            start = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many)
            node = self.kids[start + np.arange(len(start))]
        return np.concatenate(found_q or [q]), np.concatenate(found_i or [q])


def tree_hits(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """(tree, asks, hits) of some units at a time; hits are row numbers (of asks, of tree) within `radius`, block by block.

    The frames are of a partition sorted by `unit` and have node, fp, in_tree and asks.
    """
    for f in sorted_runs(frames, "unit", 20_000):
        f = f.sort_values(["unit", "node"], kind="stable", ignore_index=True)
        tree = f[f["in_tree"]].reset_index(drop=True)
        asks = f[f["asks"]].reset_index(drop=True)
        if not len(tree) or not len(asks):
            continue
        units, forest = tree["unit"].to_numpy(), BKForest(tree["unit"].to_numpy(), tree["fp"].to_numpy().view(np.uint64))
        shards, sizes = np.unique(units, return_counts=True)
        place = np.searchsorted(shards, asks["unit"])
        known = (place < len(shards)) & (shards[np.minimum(place, len(shards) - 1)] == asks["unit"])
        asks, place = asks[known].reset_index(drop=True), place[known]
        bounds = np.cumsum(sizes[place])

        def hits(asks=asks, forest=forest, place=place, bounds=bounds) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            done, fps = 0, asks["fp"].to_numpy().view(np.uint64)
            while done < len(asks):
                upto = max(done + 1, int(np.searchsorted(bounds, (bounds[done - 1] if done else 0) + PAIRS, side="right")))
                q, item = forest.search(fps[done:upto], forest.root_of_shard[place[done:upto]], radius)
                yield done + q, item
                done = upto

        yield tree, asks, hits()


def _link_units(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    for tree, asks, hits in tree_hits(frames, radius):
        nodes, number = np.unique(np.r_[tree["node"], asks["node"]], return_inverse=True)
        tree_no, ask_no = number[: len(tree)], number[len(tree) :]
        label = np.arange(len(nodes))
        for q, item in hits:
            label = local_components(len(nodes), ask_no[q], tree_no[item], label)
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        yield pd.DataFrame({"src": nodes[linked], "dst": nodes[label[linked]]})


def shard_keys(fp: Column, radius: int, blocks: int) -> list[Column]:
    """One key for each choice of blocks - radius of `blocks` bit blocks: the number of the choice and the bits in those blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    return [F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m - (m >> 63 << 64))).alias("bits")) for i, m in enumerate(chosen)]


def blocks_for(n: int, radius: int, chunk: int) -> int:
    """The fewest blocks with which n spread fingerprints leave a shard well under `chunk`; two more than the radius takes at most."""
    spread = (b for b in range(radius + 1, radius + 3) if n >> (64 * (b - radius) // b) <= chunk // 4)
    return next(spread, radius + 3)


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """Edges (src, dst) that connect the same nodes as all pairs of (node, fp) within `radius` bits.

    `fp` must be distinct. A task returns a spanning forest of the links it finds, not every
    pair, so near copies by the thousand cost rows in proportion to their number. `blocks`
    decides the size of shards, not what is found; it follows the number of nodes if not given.
    """
    spark = nodes.sparkSession
    blocks = blocks_for(nodes.count(), radius, chunk) if blocks is None else blocks
    keyed = nodes.select("node", "fp", F.inline(F.array(*shard_keys(F.col("fp"), radius, blocks))))
    sizes = keyed.groupBy("choice", "bits").count().where("count > 1")
    sizes = Scratch(spark).write(sizes.withColumn("chunks", F.ceil(F.col("count") / chunk).cast("int")).drop("count"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = keyed.join(sizes, ["choice", "bits"]).withColumn("own", own)
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = dealt.select("node", "fp", "choice", "bits", "own", others)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        F.xxhash64("choice", "bits", low, high).alias("unit"), "node", "fp",
        (F.col("own") == low).alias("in_tree"), (F.col("own") == high).alias("asks"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "unit").sortWithinPartitions("unit")
    return dealt.mapInPandas(lambda frames: _link_units(frames, radius), "src long, dst long").distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over fingerprint links.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null doc_id
    are components of their own (component_id null). Repeated rows of a doc_id keep their own
    fingerprints. An empty table gives an empty result. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.write(fingerprints(docs, shingle))
    each = fps.where("doc_id is not null")
    nodes = scratch.write(each.groupBy("fp").agg(F.min("doc_id").alias("node")))
    same = each.join(nodes, "fp").where("doc_id <> node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    parts = connected_components(fingerprint_links(nodes, radius).unionByName(same))
    found = fps.join(parts, F.col("doc_id") == F.col("node"), "left")
    return found.select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component; rows without a doc_id stay."""
    keep = simhash_components(docs, shingle, radius).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
