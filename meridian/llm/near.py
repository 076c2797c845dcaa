"""Near duplicates by SimHash, BK-trees and a test of whole shingle sets.

Two texts link if the word shingles that both have are at least SHARE of those that either
has. Their SimHash fingerprints then differ in about ten of 64 bits, too many for blocks of
equal bits to find. So shards are cut by MinHash: a text lies in BANDS shards, each named by
ROWS least hashes, and two texts that link miss each other in all of them with a chance of
(1 - SHARE ** ROWS) ** BANDS, 0.3 % at the bar itself. Each shard has a BK-tree over its
fingerprints, whose edges are followed within RADIUS bits; parities of the sets reject most
of the pairs that are near by chance, and the rest is tested by the whole sets.

Equal sets are one node. In a shard with more than a few nodes only CENTRES of them are the
tree, and the others ask; pairs are made only across what is not yet one component, round
after round with other centres, until a shard is one component or small enough for all of
its nodes to be the tree. So a large group of near copies costs rows in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from meridian.llm.simhash import majority, tree_hits
from meridian.llm.text import gram_hashes, mix, sliced
from meridian.operators.graph import connected_components
from meridian.plans.scratch import Scratch

SHINGLE = 5
#: Least share of common shingles, as a fraction.
SHARE = (4, 5)
#: Shards of a text, the least hashes that name one, and the bits within which a tree is searched.
BANDS, ROWS, RADIUS = 8, 3, 20
#: Nodes of a shard that are all compared in the first round; GROWTH times as many in each further one.
FEW, GROWTH = 12, 8
#: Nodes of a larger shard that are its tree in a round.
CENTRES = 4
#: Nodes of one tree, at most; shards with more are compared chunk by chunk.
CHUNK = 512
#: Bits of a set's parities, as 64 times so many longs.
PARITIES = 8

_TURNS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Different 64-bit hashes of the lower-cased word shingles, sorted; fewer words than `shingle` make one, no words the hash 0."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(1, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(gram_hashes(hashes, min(shingle, len(words))))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """The names of a set's shards."""
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max)
    for i in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[i : i + 4096, None] * _TURNS).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for values in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values)
    return keys


def _number(grams: np.ndarray) -> int:
    n = xxh3_64_intdigest(grams.tobytes())
    return n - (n >> 63 << 64)


def _parities(grams: np.ndarray) -> bytes:
    slots = np.bincount((grams >> np.uint64(40)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES)
    return np.packbits(slots & 1 == 1).tobytes()


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, id, n, fp, odd, bands): the number of the text's set, its size, fingerprint, parities and shards."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in sliced(frames):
            out = []
            for t in f["text"]:
                g = shingles(t)
                out.append((_number(g), len(g), majority(g).view(np.int64)[0], _parities(g), band_keys(g).view(np.int64)))
            yield pd.DataFrame({"doc_id": f["doc_id"], **{c: [x[i] for x in out] for i, c in enumerate(("id", "n", "fp", "odd", "bands"))}})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, id long, n long, fp long, odd binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, id, grams)"""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in sliced(frames):
            grams = [shingles(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "id": [_number(g) for g in grams], "grams": [g.view(np.int64) for g in grams]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, id long, grams array<long>")


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of different parts (pa, pb) that a unit's tree finds and that sizes and parities allow to link."""
    for tree, asks, found in tree_hits(frames, RADIUS):
        bits = [np.frombuffer(b"".join(f["odd"]), np.uint64).reshape(-1, PARITIES) for f in (tree, asks)]
        for q, item in found:
            id_a, part_a, na = (asks[c].to_numpy()[q] for c in ("node", "part", "n"))
            id_b, part_b, nb = (tree[c].to_numpy()[item] for c in ("node", "part", "n"))
            # in a unit of which all is the tree each pair comes up twice
            keep = (part_a != part_b) & ((id_a < id_b) | ~asks["in_tree"].to_numpy()[q])
            keep &= np.minimum(na, nb) * SHARE[1] >= np.maximum(na, nb) * SHARE[0]
            i = np.flatnonzero(keep)
            apart = np.bitwise_count(bits[1][q[i]] ^ bits[0][item[i]]).sum(axis=1, dtype=np.int64)
            i = i[apart * sum(SHARE) <= (na[i] + nb[i]) * (SHARE[1] - SHARE[0])]
            if len(i):
                turn = id_a[i] > id_b[i]
                pick = lambda x, y: np.where(turn, y[i], x[i])
                yield pd.DataFrame({"a": pick(id_a, id_b), "b": pick(id_b, id_a), "pa": pick(part_a, part_b), "pb": pick(part_b, part_a)})


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The links (pa, pb) between parts by the pairs (a, b) of ids whose sets have at least SHARE in common."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes, "id").select("id", F.col("node").alias("doc_id"))
    wanted = scratch.write(wanted)
    sets = _sets(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"))
    sets = scratch.write(sets.join(wanted, ["id", "doc_id"], "left_semi").dropDuplicates(["id"]).select("id", "grams"))
    a, b = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    either = F.size("ga") + F.size("gb") - both
    alike = scratch.write(pairs.join(a, "a").join(b, "b").where(both * SHARE[1] >= either * SHARE[0]).select("pa", "pb").distinct())
    scratch.free(sets, wanted)
    return alike


def _units(one: DataFrame, few: int) -> DataFrame:
    """Rows of `one` (g, id, fp, odd, n, part, m) dealt into units.

    A shard of at most `few` nodes is compared as a whole: in one unit, or, beyond CHUNK nodes, in one for each pair of its
    chunks. Of a larger shard each chunk is a unit, which the shard's centres go into.
    """
    value = F.struct("id", "fp", "odd", "n", "part")
    best = [F.min_by(value, F.xxhash64(F.lit(i), "part", "id")).alias(f"c{i}") for i in range(CENTRES)]
    centres = one.where(F.col("m") > few).groupBy("g").agg(F.first("m").alias("m"), *best)
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    each = F.explode(F.sequence(F.lit(0), chunks - 1))
    centres = centres.select("g", "m", F.explode(F.array_distinct(F.array(*[f"c{i}" for i in range(CENTRES)]))).alias("c"))
    centres = centres.select("g", each.alias("low"), "c.*", F.lit(True).alias("in_tree"), F.lit(False).alias("asks")).withColumn("high", F.col("low"))
    small = F.col("m") <= few
    dealt = one.withColumn("own", F.pmod(F.xxhash64("id"), chunks).cast("int"))
    whole = dealt.where(small).select("*", each.alias("other"))
    whole = whole.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    whole = whole.withColumns({"in_tree": F.col("own") == F.col("low"), "asks": F.col("own") == F.col("high")})
    rest = dealt.where(~small).withColumns({"low": F.col("own"), "high": F.col("own"), "in_tree": F.lit(False), "asks": F.lit(True)})
    columns = [F.xxhash64("g", "low", "high").alias("unit"), "g", F.col("id").alias("node"), "fp", "odd", "n", "part", "in_tree", "asks"]
    return whole.select(columns).unionByName(rest.select(columns)).unionByName(centres.select(columns))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable over links of at least SHARE.

    Null and empty texts have equal sets and link. Rows without a doc_id link nothing and
    have no row here. Rows that repeat a doc_id link by each of their texts. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    scratch = Scratch(spark)
    each = scratch.write(_sketches(docs))
    of_id = [F.first(c).alias(c) for c in ("n", "fp", "odd", "bands")]
    nodes = scratch.write(each.groupBy("id").agg(F.min("doc_id").alias("node"), *of_id))
    whole, each = each, scratch.write(each.select("doc_id", "id"))
    scratch.free(whole)
    listed = nodes.select("id", F.explode("bands").alias("g"))
    repeated = scratch.write(listed.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g"))
    members = listed.join(repeated, "g", "left_semi").join(nodes.select("id", "fp", "odd", "n"), "id")
    members = scratch.write(members.select("g", "id", "fp", "odd", "n", F.col("id").alias("part")))
    scratch.free(repeated)
    labels, few, n = None, FEW, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not members.isEmpty():
        kinds = members.groupBy("g").agg(F.count("*").alias("m"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
        kinds = scratch.write(kinds.select("g", "m"))
        old, members = members, scratch.write(members.join(kinds, "g"))
        scratch.free(old, kinds)
        units = scratch.write(_units(members, few))
        dealt = units.drop("g").repartition(n, "unit").sortWithinPartitions("unit")
        pairs = scratch.write(dealt.mapInPandas(_candidates, "a long, b long, pa long, pb long").distinct())
        links = _alike(pairs, nodes, docs, scratch)
        # parts that link become one; a node that no link has reached yet is a part by itself
        joined = scratch.write(connected_components(links, "pa", "pb").withColumnsRenamed({"node": "part", "component": "whole"}))
        if labels is None:
            labels = joined.withColumnsRenamed({"part": "id", "whole": "part"})
        else:
            new = joined.withColumnsRenamed({"part": "id", "whole": "part"}).join(labels, "id", "left_anti")
            moved = labels.join(joined, "part", "left").select("id", F.coalesce("whole", "part").alias("part"))
            labels = scratch.write(moved.unionByName(new))
        # small shards are done, and so are the centres of the others
        centres = units.where("in_tree and not asks").select("g", F.col("node").alias("id")).distinct()
        rest = members.where(F.col("m") > few).drop("m").join(centres, ["g", "id"], "left_anti").join(joined, "part", "left")
        old, members = members, scratch.write(rest.select("g", "id", "fp", "odd", "n", F.coalesce("whole", "part").alias("part")))
        scratch.free(old, units, pairs, links)
        few *= GROWTH
    # Sets are numbered by hashes, so a group is named by its smallest doc_id, over which a repeated doc_id links too.
    if labels is not None:
        each = each.join(labels, "id", "left").select("doc_id", F.coalesce("part", "id").alias("id"))
    each = scratch.write(each)
    names = scratch.write(each.groupBy("id").agg(F.min("doc_id").alias("name")))
    found = connected_components(each.join(names, "id").select("doc_id", "name"), "doc_id", "name")
    return docs.select("doc_id").distinct().join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component; rows without a doc_id stay."""
    keep = near_components(docs).where("doc_id = component_id").select("doc_id")
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
