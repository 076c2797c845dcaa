"""A Merkle manifest of a table: one root, and for each row a proof that it is under it.

The rows of each group, in order, are the leaves of a tree in which each RUN consecutive nodes
make one; the groups' roots, in order, make the root in the same way. Blocks of RUN ** HEIGHT
leaves lie in one row each and are reduced where they are. Their nodes are blocks of the next
tier, and so on until at most TOP nodes are left, whatever the table's size. Those come to the
driver, which builds what is above them and broadcasts to each its suffix path: the siblings
from it up to the root. Executors go the way back: a block joins its suffix, adds the levels
within the block, and folds each of its rows up to the root.

Digests are sha256 in lower-case hex, and inputs are concatenated as such.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meridian.llm.conversations import CRC32
from meridian.operators.ranking import row_numbers, running_within
from meridian.plans.scratch import Scratch

RUN, HEIGHT = 8, 3
BLOCK = RUN**HEIGHT
#: Nodes that the driver builds the top of the tree from, at most; a suffix path has under 7 KB, so at most 28 MB are broadcast.
TOP = 4096

#: The siblings to the left and to the right of a path's nodes, level by level, each level's joined.
Path = list[tuple[str, str]]


def leaf(columns: list[str], **other: Column) -> Column:
    """The digest of a row: `-` for a null, else the number of UTF-8 bytes, `:` and the value; `other` replaces columns."""
    parts = []
    for c in columns:
        text = other.get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """The levels over `nodes`, which are the first: `height` more, or as many as leave one node."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
    return out


def path(tree: list[list[str]], i: int) -> Path:
    """The siblings of node `i` of the first level, up to the last level."""
    out = []
    for level in tree[:-1]:
        start = i - i % RUN
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + RUN])))
        i //= RUN
    return out


def fold(node: str, siblings: Path) -> str:
    """The root that follows from a node and its siblings."""
    return reduce(lambda d, s: digest(s[0] + d + s[1]), siblings, node)


def _block_levels(block: int, leaves: list[str]) -> list[list[str]]:
    """The levels of a block. A group's only block, if not full, ends at one node; others have HEIGHT levels."""
    return levels(leaves, None if block == 0 and len(leaves) < BLOCK else HEIGHT)


def _blocks(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(g, block, rows): the nodes of (g, i, values), BLOCK to a row, in order."""
    rows = F.array_sort(F.collect_list(F.struct("i", *values))).alias("rows")
    return nodes.groupBy("g", F.floor(F.col("i") / BLOCK).alias("block")).agg(rows)


def _reduced(blocks: DataFrame) -> DataFrame:
    """(g, i, node): the node over each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            over = [_block_levels(b, [*n])[-1][0] for b, n in zip(f["block"], f["nodes"])]
            yield pd.DataFrame({"g": f["g"], "i": f["block"], "node": over})

    return blocks.select("g", "block", F.col("rows.node").alias("nodes")).mapInPandas(run, "g string, i long, node string")


def _tiers(nodes: DataFrame, values: list[str], top: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame, bool]:
    """Tables of blocks from `nodes` up, the nodes over the last of them, and whether these are at most `top`; if not, each is its group's only one."""
    tiers: list[DataFrame] = []
    while True:
        tiers.append(scratch.write(_blocks(nodes, ["node"] if tiers else values)))
        nodes = scratch.write(_reduced(tiers[-1]))
        few = nodes.count() <= top
        if few or nodes.where("i > 0").isEmpty():
            return tiers, nodes, few


_SUFFIX = "left array<string>, right array<string>, subroot string, root string"


def _descended(blocks: DataFrame, suffixes: DataFrame, value: str | None, scratch: Scratch) -> DataFrame:
    """(g, block, left, right, subroot, root) for each node of `blocks`, which is a block of the tier below.

    With `value`, the nodes are groups' roots, and `value` names the groups.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, b, nodes, names, left, right, subroot, root in f.itertuples(index=False, name=None):
                tree = _block_levels(b, [*nodes])
                paths = [path(tree, i) for i in range(len(nodes))]
                out = {"g": g if names is None else names, "block": 0 if names is not None else b * BLOCK + np.arange(len(nodes))}
                out |= {"left": [[x for x, _ in p] + [*left] for p in paths], "right": [[y for _, y in p] + [*right] for p in paths]}
                yield pd.DataFrame(out | {"subroot": nodes if names is not None else subroot, "root": root})

    names = F.col(f"rows.{value}") if value else F.lit(None).cast("array<string>")
    joined = blocks.join(suffixes, ["g", "block"]).select("g", "block", F.col("rows.node").alias("nodes"), names.alias("names"), "left", "right", "subroot", "root")
    return scratch.write(joined.mapInPandas(run, "g string, block long, " + _SUFFIX))


def _top(nodes: DataFrame, grouped: bool) -> DataFrame:
    """(g, block, left, right, subroot, root) for each of a few nodes, to be broadcast: what is above them is built here.

    `grouped`: the nodes belong to groups, whose roots make the root; else the nodes are of one tree.
    """
    held: dict[str, list[str]] = {}
    for g, _, node in sorted(map(tuple, nodes.collect()), key=lambda x: (x[0].encode(), x[1])):  # at most TOP
        held.setdefault(g, []).append(node)
    trees = {g: levels(n) for g, n in held.items()}
    over = levels([t[-1][0] for t in trees.values()])
    out = []
    for at, (g, tree) in enumerate(trees.items()):
        for i in range(len(tree[0])):
            p = path(tree, i) + path(over, at)
            out.append((g, i, [x for x, _ in p], [y for _, y in p], tree[-1][0] if grouped else None, over[-1][0]))
    return F.broadcast(nodes.sparkSession.createDataFrame(out, "g string, block long, " + _SUFFIX))


def manifest(rows: DataFrame, group: str, order: str, leaf: str, changed: str | None = None, proofs: bool = True, top: int = TOP) -> DataFrame:
    """`group`, `order` and `leaf` of each row with subroot (its group's root), root, proof_sha256 and the proof folded up to a root.

    Leaves of a group ascend by `order`, null first, equals by leaf; groups ascend by their value's bytes, null first. folded_root
    is folded from the row's own digest, or from `changed` where that is not null, over the siblings of
    `leaf`; verified says that it is the root. proof_sha256 is the digest of the siblings, level by level from the leaf, left
    to right. With `proofs` they come along as proof, an array of (left, right). Rows that repeat all three columns
    are leaves of their own, side by side. An empty table gives an empty result.

    No task holds more than blocks of BLOCK rows, the driver at most `top` nodes.
    """
    scratch = Scratch(rows.sparkSession)
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g")
    other = (F.col(changed) if changed else F.lit(None).cast("string")).alias("other")
    slim = rows.select(named, F.col(order).alias("k"), F.col(leaf).alias("node"), other)
    ranked = running_within(slim, "g", [F.col("k").asc_nulls_first(), F.col("node")], {}, "r").withColumn("i", F.col("r") - 1)
    tiers, nodes, few = _tiers(ranked, ["k", "node", "other"], top, scratch)
    if few:
        suffixes = _top(nodes, grouped=True)
    else:  # more groups than `top`: their roots are the leaves of a tree that is reduced like the others
        ranked = row_numbers(nodes.select(F.col("g").alias("name"), "node"), [F.col("name")], "r")
        ranked = ranked.select(F.lit("").alias("g"), (F.col("r") - 1).alias("i"), "node", "name")
        above, nodes, _ = _tiers(ranked, ["node", "name"], top, scratch)
        suffixes = _top(nodes, grouped=False)
        for n, tier in reversed([*enumerate(above)]):
            suffixes = _descended(tier, suffixes, None if n else "name", scratch)
    for tier in reversed(tiers[1:]):
        suffixes = _descended(tier, suffixes, None, scratch)

    columns = f"subroot string, root string, proof_sha256 string, folded_root string, verified boolean{', proof array<struct<left:string,right:string>>' if proofs else ''}"
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("k", rows.schema[order].dataType), T.StructField("node", T.StringType()), *T.StructType.fromDDL(columns)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, b, keys, leaves, others, left, right, subroot, root in f.itertuples(index=False, name=None):
                tree, rest = _block_levels(b, [*leaves]), [*zip(left, right)]
                paths = [path(tree, i) + rest for i in range(len(leaves))]
                folded = [fold(n if o is None else o, p) for n, o, p in zip(leaves, others, paths)]
                out = {"g": g, "k": keys, "node": leaves, "subroot": subroot, "root": root, "proof_sha256": [digest("".join(x + y for x, y in p)) for p in paths]}
                out |= {"folded_root": folded, "verified": [d == root for d in folded]} | ({"proof": [[{"left": x, "right": y} for x, y in p] for p in paths]} if proofs else {})
                yield pd.DataFrame(out)

    joined = tiers[0].join(suffixes, ["g", "block"]).select("g", "block", "rows.k", "rows.node", "rows.other", "left", "right", "subroot", "root")
    out = joined.mapInPandas(run, schema)
    value = F.when(F.col("g") != "", F.substr("g", F.lit(2))).cast(rows.schema[group].dataType)
    return out.select(value.alias(group), F.col("k").alias(order), F.col("node").alias(leaf), *schema.names[3:])


def folded(leaf: str, proof: str) -> Column:
    """The root that follows from a digest and a proof, as `manifest` gives it, in DataFrame functions."""
    return F.aggregate(proof, F.col(leaf), lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


#: Depths of the groups' trees and of the tree over them are reckoned from the numbers of their leaves.
SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, lang, text, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS f FROM documents),
leaf AS (SELECT doc_id, lang, f, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i FROM doc),
head AS (SELECT *, array_to_string(list_transform(f, lambda x: coalesce(strlen(x) || ':' || x, '-')), '') AS h FROM leaf),
own AS (SELECT doc_id, lang, i, sha256(h || coalesce(strlen(text) || ':' || text, '-')) AS d,
        CASE WHEN {CRC32.format("coalesce(doc_id::VARCHAR, '')")} % 3 = 0
             THEN sha256(h || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other FROM head),
size AS (SELECT lang, count(*) AS n FROM own GROUP BY lang),
deep AS (SELECT lang, list_min(list_filter(range(0, 20), lambda x: 8 ** x >= n)) AS e, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM size),
up AS (SELECT 0 AS l, k, e, i, d FROM own JOIN deep ON own.lang IS NOT DISTINCT FROM deep.lang
       UNION ALL SELECT l + 1, k, e, i // 8, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE l < e GROUP BY l, k, e, i // 8),
sub AS (SELECT k, d FROM up WHERE l = e),
high AS (SELECT 0 AS l, list_min(list_filter(range(0, 20), lambda x: 8 ** x >= n)) AS e, k AS i, d FROM sub, (SELECT count(*) AS n FROM sub)
         UNION ALL SELECT l + 1, e, i // 8, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE l < e GROUP BY l, e, i // 8),
node AS (SELECT k, l, i, d FROM up WHERE l < e UNION ALL SELECT NULL, l, i, d FROM high WHERE l < e),
run AS (SELECT k, l, i // 8 AS r, list(d ORDER BY i) AS ds FROM node GROUP BY ALL),
step AS (SELECT doc_id, t.l, run.ds, own.i // (8 ** t.l)::BIGINT % 8 AS o FROM own JOIN deep ON own.lang IS NOT DISTINCT FROM deep.lang, range(0, 20) AS t(l), run
         WHERE t.l < e AND run.k = deep.k AND run.l = t.l AND run.r = own.i // (8 ** (t.l + 1))::BIGINT
         UNION ALL SELECT doc_id, e + t.l, run.ds, deep.k // (8 ** t.l)::BIGINT % 8 FROM own JOIN deep ON own.lang IS NOT DISTINCT FROM deep.lang, range(0, 20) AS t(l), run
         WHERE t.l < (SELECT max(e) FROM high) AND run.k IS NULL AND run.l = t.l AND run.r = deep.k // (8 ** (t.l + 1))::BIGINT),
proof AS (SELECT doc_id, list({{'a': array_to_string(ds[1:o], ''), 'b': array_to_string(ds[o + 2:], '')}} ORDER BY l) AS p FROM step GROUP BY doc_id),
whole AS (SELECT own.doc_id, own.d AS leaf, coalesce(other, own.d) AS start, sub.d AS subroot, (SELECT d FROM high WHERE l = e) AS root, coalesce(p, []) AS p
          FROM own JOIN deep ON own.lang IS NOT DISTINCT FROM deep.lang JOIN sub ON sub.k = deep.k LEFT JOIN proof ON proof.doc_id IS NOT DISTINCT FROM own.doc_id),
told AS (SELECT *, list_reduce(list_prepend({{'a': start, 'b': ''}}, p), lambda x, y: {{'a': sha256(y.a || x.a || y.b), 'b': ''}}).a AS folded_root,
         sha256(array_to_string(list_transform(p, lambda x: x.a || x.b), '')) AS proof_sha256 FROM whole)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM told
"""
