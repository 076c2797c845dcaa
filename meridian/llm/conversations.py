"""A prefix trie over conversations, rolled up by pointer jumping.

A prefix is named by its depth and by sums of hashes of its turns and their places. Such sums
are running sums, so the names of all prefixes of a conversation come from ranges of turns,
however long it is, and a prefix knows its parent's name: its own sums less those of its
last turn. Equal names are one node.

The rollup doubles distances. After round k a node's totals cover its descendants nearer than
2^k and its pointer names the ancestor 2^k above. Each node with a pointer adds its totals
to the node it points at, and takes that node's pointer. So a trie of depth D takes
log2(D) rounds, of which each handles only nodes at least 2^k deep.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from meridian.operators.ranking import ranged, running_within
from meridian.plans.scratch import Scratch

#: Turns that a conversation takes from another are fewer than this, and their number is a hash modulo it.
SHARED = 6
#: The first conversation of each so many lends its turns.
FAMILY = 100
#: Ids that are joined into one text before they are hashed.
CHUNK = 500

_SUMS = ["s0", "s1", "s2", "s3"]
_KEY, _UP = ["a", "b"], ["pa", "pb"]


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, p, digest, chars): the turns of each conversation, numbered from 1 in their order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = turns.where("conv_id is not null").select("conv_id", "turn", F.substring(F.unhex(content), 1, 16).alias("digest"), F.length(text).cast("long").alias("chars"))
    return running_within(slim, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], {}, "p").drop("turn")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n, p, digest, chars) of the rebuilt conversations, and (conv_id, n), the number of turns of each.

    A conversation c starts with the first h turns of conversation c - c % 100 (all of them
    if it has fewer, none if there is no such conversation) and goes on with its own turns
    after its first h, h being the crc32 of c as text modulo 6.
    """
    numbered = scratch.write(_numbered(turns))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = numbered.groupBy("conv_id").agg(F.max("p").alias("own"))
    convs = convs.select("conv_id", base.alias("base"), "own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h"))
    heads = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("p") < SHARED))  # at most five rows a conversation
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("p", "digest", "chars"))).alias("head"))
    lent = F.when(F.col("head").isNull(), 0).otherwise(F.least(F.col("h"), F.size("head")))
    plans = scratch.write(convs.join(heads, "base", "left").select("conv_id", "h", F.expr("slice(head, 1, int(h))").alias("head"), lent.alias("lent"), (lent + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")))
    shared = plans.select("conv_id", "n", F.inline("head"))
    own = numbered.join(plans.select("conv_id", "n", "h", "lent"), "conv_id").where("p > h").select("conv_id", "n", (F.col("p") - F.col("h") + F.col("lent")).alias("p"), "digest", "chars")
    return shared.unionByName(own), plans.select("conv_id", "n")


def _name(depth: F.Column, sums: list[F.Column], names: list[str]) -> list[F.Column]:
    return [F.xxhash64(F.lit(i), depth, *sums).alias(c) for i, c in enumerate(names)]


def _digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) from (a, b, conv_id): the sha256 of a node's ids, ascending and joined by commas.

    A node may hold any share of the ids. Ranges of them are joined into texts of at most
    CHUNK ids, and only those texts meet in one task, which hashes them as they come.
    """
    numbered = ranged(ends, [F.col("a"), F.col("b"), F.col("conv_id")]).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(*_KEY, "conv_id")))
    chunks = numbered.groupBy("part", F.floor(F.col("r") / CHUNK).alias("c"), *_KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for f in frames:
            done = []
            for a, b, ids in zip(f["a"], f["b"], f["ids"]):
                if (a, b) == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["a", "b", "ends_sha256"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "part", "c").select(*_KEY, "ids").mapInPandas(run, "a long, b long, ends_sha256 string")


def rollup(nodes: DataFrame, scratch: Scratch, deepest: int) -> tuple[DataFrame, DataFrame]:
    """What all descendants add: rows (a, b, n_children, n_leaves, saved) to be summed by node, and (a, b, parent_conv_id) of nodes under depth 1.

    `nodes` has a, b, conv_id, depth, n_leaves, saved and (pa, pb), which names the parent; only the root, at depth 0, has none. `deepest` is the
    greatest depth. A node that many point at is summed map-side; looking up its pointer is a join
    of two written tables, which AQE can split.
    """
    active = scratch.write(nodes.where("depth > 0").select(*_KEY, *_UP, "conv_id", "depth", "n_leaves", "saved"))
    gained, parents, reach = None, None, 1
    while reach <= deepest:
        above = active.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"))
        kids = F.count("*") if reach == 1 else F.lit(0).cast("long")
        sums = scratch.write(above.agg(kids.alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")))
        gained = sums if gained is None else gained.unionByName(sums)
        if 2 * reach > deepest:
            break
        rest = active.where(F.col("depth") >= 2 * reach)
        target = active.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv_id").alias("of"))
        jumped = rest.join(target, _UP).select(*_KEY, F.col("qa").alias("pa"), F.col("qb").alias("pb"), "of", "conv_id", "depth", "n_leaves", "saved")
        more = sums.select(*_KEY, F.col("n_leaves").alias("l"), F.col("saved").alias("s"))
        added = {"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}
        active = scratch.write(jumped.join(more, _KEY, "left").withColumns(added).drop("l", "s"))
        parents = active.select(*_KEY, F.col("of").alias("parent_conv_id")) if parents is None else parents
        active = active.drop("of")
        reach *= 2
    return gained, parents


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations of `turns` (conv_id, turn, role, text), one row each.

    conv_id is the smallest member (a conversation that starts with the node's turns), parent_conv_id
    the parent's; depth, n_convs (members), n_children, n_leaves (nodes without children at
    or under it), saved_tokens (over its subtree, a node's members but one times the length of its
    last text in code points) and ends_sha256 (the members that have no further turn).

    Turns are ordered by turn, null first; of equal turns the order is that of a digest of role
    and text, so repeated rows are repeated turns. Null role and text count as empty. Rows with a
    null conv_id belong to no conversation. Other columns are not read. An empty table has no nodes,
    not even a root.
    """
    scratch = Scratch(turns.sparkSession)
    rows, convs = rebuilt(turns, scratch)
    halves = [F.xxhash64(F.lit(i), "p", "digest") for i in (0, 1)]
    parts = [p for h in halves for p in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    rows = rows.withColumns(dict(zip(["x0", "x1", "x2", "x3"], parts)))
    rows = running_within(rows, "conv_id", [F.col("p")], {s: F.col(f"x{i}") for i, s in enumerate(_SUMS)})
    here, above = [F.col(s) for s in _SUMS], [F.col(s) - F.col(f"x{i}") for i, s in enumerate(_SUMS)]
    rows = scratch.write(rows.select("conv_id", "n", "p", "chars", *_name(F.col("p"), here, _KEY), *_name(F.col("p") - 1, above, _UP)))
    # a node has no child if all its members end there
    of_node = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum((F.col("p") == F.col("n")).cast("long")).alias("n_ends"), *[F.first(c).alias(c) for c in ("chars", "pa", "pb")]]
    below = rows.groupBy(*_KEY, F.col("p").alias("depth")).agg(*of_node)
    zero, none = [F.lit(0).cast("long")] * len(_SUMS), F.lit(None).cast("long")
    at_root = _name(F.lit(0).cast("long"), zero, _KEY)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum((F.col("n") == 0).cast("long")).alias("n_ends")).where("n_convs > 0")
    root = root.select(*at_root, F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", "n_ends", F.lit(0).cast("long").alias("chars"), *[none.alias(c) for c in _UP])
    nodes = below.unionByName(root).withColumns({"n_leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = scratch.write(nodes)
    deepest, first = nodes.agg(F.max("depth"), F.min("conv_id")).head()
    gained, parents = rollup(nodes, scratch, deepest or 0)
    last = rows.where("p = n").select(*_KEY, "conv_id").unionByName(convs.where("n = 0").select(*at_root, "conv_id"))
    # what is known of a node meets in one shuffle by its name; most nodes of the first level have one parent, whose id is known
    own = nodes.select(*_KEY, "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(first)).alias("parent_conv_id"), "n_convs", "n_leaves", "saved")
    for more in (gained, parents, _digests(last)):
        own = own if more is None else own.unionByName(more, allowMissingColumns=True)
    if "n_children" not in own.columns:
        own = own.withColumn("n_children", none)
    out = own.groupBy(*_KEY).agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")], *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_children", "n_children"), ("n_leaves", "n_leaves"), ("saved", "saved_tokens"))],
        F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return out.drop(*_KEY)


#: crc32 of a decimal number as text; {0} is the number.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

SQL = f"""
WITH conv AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l, {CRC32.format("conv_id")} % 6 AS h
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
seq AS (SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l FROM conv c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 100),
pre AS (SELECT conv_id, d, l[1:d] AS k, len(l) AS n FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM seq)),
node AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM pre GROUP BY d, k),
kid AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
tree AS (SELECT node.*, coalesce(kid.n, 0) AS n_children, (n_convs - 1) * CASE WHEN node.d = 0 THEN 0 ELSE length(node.k[node.d].t) END AS own FROM node LEFT JOIN kid ON kid.d = node.d AND kid.k = node.k),
up AS (SELECT *, unnest(range(0, d + 1)) AS e FROM tree),
total AS (SELECT e AS d, k[1:e] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved FROM up GROUP BY ALL)
SELECT t.conv_id, t.d AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM tree t JOIN total s ON s.d = t.d AND s.k = t.k LEFT JOIN node p ON p.d = t.d - 1 AND p.k = t.k[1:t.d - 1]
"""
