"""Graph operators as iterative DataFrame programs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from meridian.plans.scratch import Scratch

#: Links that one task joins at last; links of a partition that are joined at once.
FEW, AT_ONCE = 1_000_000, 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least): all ends of the links, and the smallest node that each reaches over them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label, turn = np.arange(len(nodes)), 0
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            break
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        low, high = np.minimum(p, q), np.maximum(p, q)
        np.maximum.at(label, low, high) if turn % 2 else np.minimum.at(label, high, low)  # by turns, so that stars fold at once and chains halve
        while (label[label] != label).any():
            label = label[label]
        turn += 1
    least = np.full(len(nodes), len(nodes))
    np.minimum.at(least, label, np.arange(len(nodes)))
    return nodes, nodes[least[label]]


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) of a partition as one link (u, v) from the smallest node of what they join to each other node of it."""
    held, more = None, 0
    for f in frames:
        held = [f] if held is None else [*held, f]
        more += len(f)
        if more >= AT_ONCE:
            held, more = [_star(held)], 0
    if held is not None:
        yield _star(held)


def _star(frames: list[pd.DataFrame]) -> pd.DataFrame:
    f = pd.concat(frames, ignore_index=True)
    nodes, least = least_reachable(f["u"].to_numpy(), f["v"].to_numpy())
    return pd.DataFrame({"u": least[nodes != least], "v": nodes[nodes != least]})


def components_by_parts(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """As `connected_components`, for links that are many among few nodes, or few at all.

    Each partition first keeps a star for each part that its links join, so no more links than nodes of a partition are written or shuffled.
    If at most FEW are left, one task joins them; else they go through the rounds.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = scratch.write(e.mapInPandas(_stars, e.schema))
    if e.count() > FEW:
        return connected_components(e, "u", "v")
    stars = scratch.write(e.coalesce(1).mapInPandas(_stars, e.schema))
    heads = stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(heads)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return (node, component) for every node of `edges`; component is the smallest reachable node.

    Each round hooks every node to the least of its neighbours and itself and rewrites
    the edges onto those hooks. Even rounds order nodes by id, which folds a star around
    its smallest member at once; odd rounds order them by a hash, which halves long
    chains whatever their numbering. Hubs are aggregated, never gathered, and the
    rewriting joins have a shuffle on both sides that AQE can split.
    Null ends and self-loops link nothing; a self-loop alone yields no row. Repeated
    edges count once. An empty table gives an empty result.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    e = scratch.write(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    labels, turn = None, 0
    while not e.isEmpty():
        order = (lambda c: F.xxhash64(F.lit(turn), c)) if turn % 2 else (lambda c: F.col(c))
        both = e.union(e.select("v", "u"))
        hook = both.groupBy("u").agg(F.min_by("v", order("v")).alias("m"))
        hook = scratch.write(hook.select("u", F.when(order("m") < order("u"), F.col("m")).otherwise(F.col("u")).alias("m")))
        # a compressed file tells little of a table's size, so these joins are merges and the driver gathers none of it
        mu, mv = hook.withColumnRenamed("m", "mu").hint("merge"), hook.withColumnsRenamed({"u": "v", "m": "mv"}).hint("merge")
        moved = e.join(mu, "u").join(mv, "v").where("mu <> mv")
        old = e, labels
        e = scratch.write(moved.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct())
        step = hook.select(F.col("u").alias("root"), "m").hint("merge")
        if labels is None:
            labels = scratch.write(hook.select(F.col("u").alias("node"), F.col("m").alias("root")))
        else:
            labels = scratch.write(labels.join(step, "root", "left").select("node", F.coalesce("m", "root").alias("root")))
        scratch.free(hook, *[t for t in old if t is not None])
        turn += 1
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(scratch.write(least).hint("merge"), "root").select("node", "component")
