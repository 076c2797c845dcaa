"""Joins by distance and direction, and cells.

Points fall into square cells as wide as the search radius, so what is near lies in a cell
or its neighbours. One side is copied to those, and the rest is an equi-join that Spark
shuffles, with an exact test after it. No side is broadcast and no pair is made that does
not share a neighbourhood.

Spark guesses the size of a table from its files and does not count the copies that an explode makes,
so joins with copies have the hint MERGE; else the copies of a small file would be gathered by the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from meridian.functions import geo
from meridian.plans.scratch import Scratch


def _cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def cell_pairs(a: DataFrame, b: DataFrame, radius: float, extra: tuple[str, float] | None = None) -> DataFrame:
    """Candidate pairs of two frames with x and y, as columns a.* and b.* (structs).

    Every pair within `radius` is among them once. `extra` names a third coordinate of
    both and its own limit.
    """
    around = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    left = a.select(F.struct("*").alias("a"), _cell("x", radius).alias("cx"), _cell("y", radius).alias("cy"), *([_cell(*extra).alias("ct")] if extra else []))
    right = b.select(F.struct("*").alias("b"), _cell("x", radius).alias("bx"), _cell("y", radius).alias("by"), *([_cell(*extra).alias("bt")] if extra else []))
    right = right.select("*", around.alias("dx")).select("*", around.alias("dy"))
    keys = {"cx": F.col("bx") + F.col("dx"), "cy": F.col("by") + F.col("dy")}
    if extra:
        right = right.select("*", around.alias("dt"))
        keys["ct"] = F.col("bt") + F.col("dt")
    right = right.select("b", *[c.alias(k) for k, c in keys.items()])
    return left.join(right.hint("merge"), list(keys)).select("a", "b")


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b, dist) of points at most `radius` apart. Rows without a position match nothing."""
    sound = "x is not null and y is not null"
    pairs = cell_pairs(a.where(sound), b.where(sound), radius)
    dist = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return pairs.withColumn("dist", dist).where(F.col("dist") <= radius)


#: Pairs of points of two cells that are made; cells with more are split.
MOST_PAIRS = 4096
#: Halvings of a cell, at most.
DEEPEST = 24
#: Rounds of doubling the radius before far points are looked for from above; points of a cell that are all looked at.
DOUBLINGS, FEW = 4, 64


def _boxes(points: DataFrame, side: float, sums: list[str], prefix: str) -> DataFrame:
    """Cells of `side` with the box that their points fill, the number of them and their sums, under names with `prefix`."""
    box = [F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]]
    out = points.groupBy(_cell("x", side).alias("cx"), _cell("y", side).alias("cy")).agg(*box)
    return out.select(*[F.col(c).alias(prefix + c) for c in out.columns])


def near_totals(a: DataFrame, b: DataFrame, radius: float, sums: list[str]) -> DataFrame:
    """(id, n, sums) of each point of `a` that has any within `radius`: the number and sums of the points of `b` there.

    Cells are compared before points. Where the boxes of two cells' points are within the radius all over, one cell adds its sums to the other; where
    they are nowhere, nothing is done; else the cells are halved, until there are at most MOST_PAIRS pairs of
    points to be tested. So a crowded cell costs the rim of the circle, not its square, and many points at one place cost nothing. What
    a cell gained is handed to its points by one join a level.
    """
    scratch = Scratch(a.sparkSession)
    sound = "abs(x) < double('infinity') and abs(y) < double('infinity')"  # neither null nor NaN
    a = scratch.write(a.where(sound).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    b = scratch.write(b.where(sound).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums]))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a{c}1") - F.col(f"b{c}2"), F.col(f"b{c}1") - F.col(f"a{c}2"))
    reach = lambda c: F.greatest(F.col(f"a{c}2") - F.col(f"b{c}1"), F.col(f"b{c}2") - F.col(f"a{c}1"))
    found, split, side = [], None, radius
    for level in range(DEEPEST + 1):
        ours, theirs = _boxes(a, side, [], "a"), _boxes(b, side, sums, "b")
        if split is None:
            around = [F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias(d) for d in ("dx", "dy")]
            sent = theirs.select("*", around[0]).select("*", around[1]).withColumns({"acx": F.col("bcx") + F.col("dx"), "acy": F.col("bcy") + F.col("dy")})
            pairs = ours.join(sent.drop("dx", "dy").hint("merge"), ["acx", "acy"])
        else:
            up = lambda df, p: df.withColumns({f"{p}ux": F.floor(F.col(f"{p}cx") / 2), f"{p}uy": F.floor(F.col(f"{p}cy") / 2)})
            pairs = split.join(up(ours, "a"), ["aux", "auy"]).join(up(theirs, "b"), ["bux", "buy"])
        pairs = pairs.where(F.hypot(gap("x"), gap("y")) <= radius).withColumn("whole", F.hypot(reach("x"), reach("y")) <= radius)
        few = F.lit(True) if level == DEEPEST else F.col("an") * F.col("bn") <= MOST_PAIRS
        pairs = scratch.write(pairs.withColumn("few", few))
        gained = pairs.where("whole").groupBy("acx", "acy").agg(F.sum("bn").alias("n"), *[F.sum(f"b{c}").alias(c) for c in sums])
        of_a = [_cell("x", side).alias("acx"), _cell("y", side).alias("acy")]
        of_b = b.select(F.col("x").alias("__x"), F.col("y").alias("__y"), *sums, _cell("x", side).alias("bcx"), _cell("y", side).alias("bcy"))
        found.append(a.select("id", *of_a).join(gained.hint("merge"), ["acx", "acy"]).select("id", "n", *sums))
        tested = pairs.where("few and not whole").select("acx", "acy", "bcx", "bcy")
        tested = a.select("id", "x", "y", *of_a).join(tested.hint("merge"), ["acx", "acy"]).join(of_b.hint("merge"), ["bcx", "bcy"])
        tested = tested.where(F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")) <= radius)
        found.append(tested.groupBy("id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]))
        split = pairs.where("not few and not whole").select(*[F.col(f"{p}c{c}").alias(f"{p}u{c}") for p in "ab" for c in "xy"])
        if split.isEmpty():
            break
        side /= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])


def near_links(points: DataFrame, radius: float) -> DataFrame:
    """(src, dst) between points (id, x, y) such that what they link is what all pairs at most `radius` apart link.

    Each point is linked to the first of its cell, whose points are all within the radius of each other, and two cells by the first
    pair of points found, so there are no more links than points and pairs of near cells. Pairs of cells are settled by the boxes of their points,
    or halved as in `near_totals`, until there are few points to be tested; a pair of cells that is linked is not looked at again.
    So a crowded cell makes no pairs within itself. A point with none within the radius has no link.
    """
    scratch, size = Scratch(points.sparkSession), radius / 2
    sound = "abs(x) < double('infinity') and abs(y) < double('infinity')"  # neither null nor NaN
    p = points.where(sound).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = scratch.write(p.select("*", _cell("x", size).alias("tx"), _cell("y", size).alias("ty")))
    heads = scratch.write(p.groupBy("tx", "ty").agg(F.min("id").alias("head")))
    within = p.join(heads.hint("merge"), ["tx", "ty"]).where("id <> head").select(F.col("head").alias("src"), F.col("id").alias("dst"))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a{c}1") - F.col(f"b{c}2"), F.col(f"b{c}1") - F.col(f"a{c}2"))
    reach = lambda c: F.greatest(F.col(f"a{c}2") - F.col(f"b{c}1"), F.col(f"b{c}2") - F.col(f"a{c}1"))

    def boxes(side: float, prefix: str) -> DataFrame:
        box = [F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("n")]
        out = p.groupBy("tx", "ty", _cell("x", side).alias("cx"), _cell("y", side).alias("cy")).agg(*box)
        return out.select(*[F.col(c).alias(prefix + c) for c in out.columns])

    top = ["atx", "aty", "btx", "bty"]
    linked, split, side = None, None, size
    for level in range(DEEPEST + 1):
        ours, theirs = boxes(side, "a"), boxes(side, "b")
        if split is None:
            around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-3, 4) for j in range(-3, 4) if (i, j) > (0, 0)]))
            sent = theirs.select("*", around.alias("d")).withColumns({"atx": F.col("btx") - F.col("d.dx"), "aty": F.col("bty") - F.col("d.dy")}).drop("d")
            pairs = ours.join(sent.hint("merge"), ["atx", "aty"])
        else:
            up = lambda df, c: df.withColumns({f"{c}ux": F.floor(F.col(f"{c}cx") / 2), f"{c}uy": F.floor(F.col(f"{c}cy") / 2)})
            pairs = split.join(up(ours, "a").hint("merge"), ["atx", "aty", "aux", "auy"]).join(up(theirs, "b").hint("merge"), ["btx", "bty", "bux", "buy"])
        pairs = pairs.where(F.hypot(gap("x"), gap("y")) <= radius).withColumn("whole", F.hypot(reach("x"), reach("y")) <= radius)
        few = F.lit(True) if level == DEEPEST else F.col("an") * F.col("bn") <= MOST_PAIRS
        pairs = scratch.write(pairs.select(*top, "acx", "acy", "bcx", "bcy", "whole", few.alias("few")))
        of = lambda c: p.select(*[F.col(n).alias(f"{c}{n}") for n in ("tx", "ty", "x", "y")], _cell("x", side).alias(f"{c}cx"), _cell("y", side).alias(f"{c}cy"))
        sure = pairs.where("whole").select(*top).distinct()
        asked = pairs.where("few and not whole").join(sure.hint("merge"), top, "left_anti")
        tested = of("a").join(asked.hint("merge"), ["atx", "aty", "acx", "acy"]).join(of("b").hint("merge"), ["btx", "bty", "bcx", "bcy"])
        tested = tested.where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= radius)
        now = scratch.write(sure.unionByName(tested.select(*top)).distinct())
        linked = now if linked is None else linked.unionByName(now)
        split = pairs.where("not few and not whole").join(now.hint("merge"), top, "left_anti")
        split = scratch.write(split.select(*top, *[F.col(f"{c}c{i}").alias(f"{c}u{i}") for c in "ab" for i in "xy"]))
        if split.isEmpty():
            break
        side /= 2
    a, b = heads.toDF("atx", "aty", "src"), heads.toDF("btx", "bty", "dst")
    between = linked.distinct().join(a.hint("merge"), ["atx", "aty"]).join(b.hint("merge"), ["btx", "bty"]).select("src", "dst")
    return within.unionByName(between)


def near_sums(a: DataFrame, b: DataFrame, radius: float, weight: str) -> DataFrame:
    """`a` (by id) with n, total and mean of `weight` over the points of `b` within `radius`.

    A null weight adds nothing and counts in the mean. Without points n and total are 0
    and the mean is null.
    """
    sums = near_totals(a, b.select("x", "y", F.col(weight).cast("double").alias("total")), radius, ["total"])
    out = a.join(sums, "id", "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0.0)), "mean": F.col("total") / F.col("n")})


def neighbour_density(units: DataFrame, radius: float, years: int) -> DataFrame:
    """(id, density): count per 100 m and year over the other units within `radius`; 0 without any.

    `units` has id, x, y, count and length (metres); a null count or length adds nothing.
    """
    sums = near_totals(units, units, radius, ["count", "length"]).toDF("id", "__n", "__c", "__l")
    own = units.select("id", F.coalesce("count", F.lit(0)).alias("c"), F.coalesce("length", F.lit(0)).alias("l")).join(sums, "id", "left")
    density = (F.col("__c") - F.col("c")) / F.nullif((F.col("__l") - F.col("l")) / 100, F.lit(0.0)) / years
    return own.select("id", F.coalesce(F.when(F.col("__n") > 1, density), F.lit(0.0)).alias("density"))


def _far_nearest(a: DataFrame, b: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, near_id, dist) of the nearest point of `b`, however far, for points that have none around.

    From above: `b` is cut into at most 25 cells, of which a point keeps those that may hold its nearest: whose nearest place is no further than the
    furthest of some cell. Those are cut into 16, and so on, until a cell has at most FEW points or is small beyond measure, of which
    all are looked at. Rounds go with the logarithm of the extent, whatever the distance.
    """
    ends = b.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("u"), F.max("y").alias("v")).first()
    side = max(ends["u"] - ends["x"], ends["v"] - ends["y"]) / 4
    here = lambda c, low, s: F.floor((F.col(c) - low) / s) if s > 0 else F.lit(0).cast("long")
    cells = lambda s: [here("x", ends["x"], s).alias("cx"), here("y", ends["y"], s).alias("cy")]
    asks, found = None, None
    for level in range(DEEPEST // 2 + 1):
        boxes = b.groupBy(*cells(side)).agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("n"))
        if asks is None:
            top = boxes.agg(F.collect_list(F.struct(*boxes.columns)).alias("boxes"))  # at most 25
            pairs = a.join(F.broadcast(top)).select("id", "x", "y", F.inline("boxes"))
        else:
            pairs = asks.join(boxes.withColumns({"ux": F.floor(F.col("cx") / 4), "uy": F.floor(F.col("cy") / 4)}), ["ux", "uy"]).drop("ux", "uy")
        gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}1") - F.col(c), F.col(c) - F.col(f"{c}2"))
        reach = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"{c}1")), F.abs(F.col(f"{c}2") - F.col(c)))
        pairs = scratch.write(pairs.select("id", "x", "y", "cx", "cy", "n", F.hypot(gap("x"), gap("y")).alias("least"), F.hypot(reach("x"), reach("y")).alias("most")))
        bound = pairs.groupBy("id").agg(F.min("most").alias("bound"))
        if found is not None:
            bound = bound.join(found.select("id", F.col("m.dist").alias("d")), "id", "left").select("id", F.least("bound", "d").alias("bound"))
        kept = scratch.write(pairs.join(bound, "id").where(F.col("least") <= F.col("bound") * (1 + 1e-12)))
        last = F.lit(True) if level == DEEPEST // 2 or side == 0 else F.col("n") <= FEW
        looked = kept.where(last).select("id", "x", "y", "cx", "cy").join(b.select(F.col("id").alias("near_id"), F.col("x").alias("u"), F.col("y").alias("v"), *cells(side)), ["cx", "cy"])
        hits = looked.groupBy("id").agg(F.min(F.struct(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v")).alias("dist"), "near_id")).alias("m"))
        found = hits if found is None else found.unionByName(hits).groupBy("id").agg(F.min("m").alias("m"))
        found = scratch.write(found)
        asks = kept.where(~last).select("id", "x", "y", F.col("cx").alias("ux"), F.col("cy").alias("uy"))
        if asks.isEmpty():
            break
        side /= 4
    return found.select("id", F.col("m.near_id").alias("near_id"), F.col("m.dist").alias("dist"))


def nearest(a: DataFrame, b: DataFrame, radius: float, limit: float | None = None) -> DataFrame:
    """(id, near_id, dist): for each point of `a` the nearest of `b`; equal distances go to the smaller id.

    Looks within `radius` first and doubles it for those that found nothing, up to `limit`. Without a limit, what has found nothing after
    a few rounds is looked for from above, in ever smaller cells of `b`, so that a far point costs no more than a near one. Points
    of an `a` without any `b` in reach have no row.
    """
    sound = "abs(x) < double('infinity') and abs(y) < double('infinity')"  # neither null nor NaN
    left, out, r = a.where(sound).select("id", "x", "y"), None, radius
    b = b.where(sound).select("id", "x", "y")
    scratch, rounds = Scratch(a.sparkSession), 0
    while True:
        reach = r if limit is None else min(r, limit)
        hit = within(left, b, reach).groupBy(F.col("a.id").alias("id"))
        hit = scratch.write(hit.agg(F.min(F.struct("dist", "b.id")).alias("m")).select("id", F.col("m.id").alias("near_id"), F.col("m.dist").alias("dist")))
        out = hit if out is None else out.unionByName(hit)
        if limit is not None and reach >= limit:
            break
        left = scratch.write(left.join(hit, "id", "left_anti"))
        if left.isEmpty() or b.isEmpty():
            break
        rounds += 1
        if limit is None and rounds == DOUBLINGS:
            out = out.unionByName(_far_nearest(left, b, scratch))
            break
        r *= 2
    return out


def line_cells(lines: DataFrame, size: float, pad: float) -> DataFrame:
    """`lines` (x1, y1, x2, y2) once for each square cell that their padded box touches, as cx, cy."""
    span = lambda p, q: F.explode(F.sequence(F.floor((F.least(p, q) - pad) / size), F.floor((F.greatest(p, q) + pad) / size)))
    return lines.select("*", span("x1", "x2").alias("cx")).select("*", span("y1", "y2").alias("cy"))


def points_near_lines(points: DataFrame, lines: DataFrame, radius: float) -> DataFrame:
    """Pairs (p, l, dist) of points and segments (id, x1, y1, x2, y2) at most `radius` apart, each once."""
    p = points.where("x is not null and y is not null").select(F.struct("*").alias("p"), _cell("x", radius).alias("cx"), _cell("y", radius).alias("cy"))
    cells = line_cells(lines, radius, radius)
    cells = cells.select(F.struct(*lines.columns).alias("l"), "cx", "cy")
    ends = [F.col(f"l.{c}") for c in ("x1", "y1", "x2", "y2")]
    dist = geo.point_segment_distance(F.col("p.x"), F.col("p.y"), *ends)
    return p.join(cells.hint("merge"), ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= radius).select("p", "l", "dist")


#: Side of a tile over the radius; points, and lines, that a group of a tile has, about; pairs that a task makes at once.
TILE, MOST_IN_TILE, AT_ONCE = 1.25, 100_000, 1_000_000


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k) with k from first[i] up to last[i], for all i."""
    n = last - first
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def nearest_of_tile(p: np.ndarray, turn: np.ndarray | None, ends: np.ndarray, pad: float, angle: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(point, line) such that each point's nearest line within `pad` is among its pairs, and others only if as near up to the last digits.

    `p` has rows x, y, `ends` rows x1, y1, x2, y2; `turn` are the points' directions in radians, to which a line must be within `angle` degrees. Lines
    are dealt by direction and sorted by their distance from the middle of the tile. A line near a point has about that distance from the middle that the
    point has across the direction, so each direction gives a short stretch of lines, which is the shorter the smaller the distance looked for.
    """
    middle = (p.min(0) + p.max(0)) / 2
    q, e = p - middle, ends - np.tile(middle, 2)
    d = e[:, 2:] - e[:, :2]
    square = (d * d).sum(1)
    heading = np.arctan2(d[:, 1], d[:, 0])
    few = len(p) * len(e) <= AT_ONCE
    n = 1 if few else min(360, max(16, int(len(e) ** 0.5)))
    kind = np.minimum(((heading % np.pi) * n / np.pi).astype(int), n - 1)
    own = heading % np.pi
    across = -np.sin(own) * e[:, 0] + np.cos(own) * e[:, 1]
    order = np.lexsort((across, kind))
    starts = np.searchsorted(kind[order], np.arange(n + 1))
    slack = np.hypot(q[:, 0], q[:, 1]).max() * np.pi / (2 * n) * (1 + 1e-9)
    best, out, left, reach = np.full(len(p), np.inf), [], np.arange(len(p)), pad if few else pad / 256

    def test(i: np.ndarray, k: np.ndarray, far: float) -> None:
        t = np.clip(((q[i] - e[k, :2]) * d[k]).sum(1) / np.where(square[k] == 0, 1, square[k]), 0, 1)
        dist = np.hypot(*(q[i] - e[k, :2] - t[:, None] * d[k]).T)
        near = dist <= far
        sure = near
        if angle is not None:
            off = np.abs(np.degrees(turn[i] - heading[k])) % 180
            off = np.minimum(off, 180 - off)
            near, sure = near & (off <= angle + 1e-9), near & (off <= angle - 1e-9)
        np.minimum.at(best, i[sure], dist[sure])
        keep = near & (dist <= best[i] * (1 + 1e-9) + 1e-9)
        out.append((i[keep], k[keep], dist[keep]))

    while len(left):
        far = reach * (1 + 1e-9) + 1e-9
        for b in range(n):
            lines = order[starts[b] : starts[b + 1]]
            asks = left
            if angle is not None and n > 1:
                off = np.abs(turn[left] - (b + 0.5) * np.pi / n) % np.pi
                asks = left[np.minimum(off, np.pi - off) <= np.radians(angle) + np.pi / (2 * n) + 1e-9]
            if not len(lines) or not len(asks):
                continue
            if few:
                first, last = np.zeros(len(asks), int), np.full(len(asks), len(lines))
            else:
                at = -np.sin((b + 0.5) * np.pi / n) * q[asks, 0] + np.cos((b + 0.5) * np.pi / n) * q[asks, 1]
                first, last = (np.searchsorted(across[lines], at + g * (far + slack), side) for g, side in ((-1, "left"), (1, "right")))
            total = np.cumsum(last - first)
            for part in np.split(np.arange(len(asks)), np.searchsorted(total, np.arange(AT_ONCE, total[-1], AT_ONCE))):
                i, k = _spread(first[part], last[part])
                test(asks[part[i]], lines[k], far)
        if reach >= pad:
            break
        left = left[best[left] > reach]
        reach = min(pad, reach * 8)
    i, k, dist = (np.concatenate(c) if out else np.empty(0, int) for c in (zip(*out) if out else ((), (), ())))
    keep = dist <= best[i] * (1 + 1e-9) + 1e-9
    pairs = np.unique(np.stack([i[keep], k[keep]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def nearest_lines(points: DataFrame, lines: DataFrame, radius: float, angle: float | None = None) -> DataFrame:
    """(id, line, dist, along): for each point the nearest segment (id, x1, y1, x2, y2) within `radius`; equal distances go to the smaller id.

    With `angle` points have dx and dy, and a segment must run within that many degrees of this direction, either way. along is the metres from the segment's start to the place
    nearest to the point. Points and segments meet in tiles a little wider than the radius, of which a task looks through one without making all pairs
    (`nearest_of_tile`). Points that find nothing close get the segments of the whole radius afterwards.
    """
    scratch, side = Scratch(points.sparkSession), radius * TILE
    angle = None if angle is None or angle >= 90 else angle
    sound = lambda *c: " and ".join(f"abs({n}) < double('infinity')" for n in c)  # noqa: E731  # neither null nor NaN
    own = ["x", "y", *(("dx", "dy") if angle is not None else ())]
    both = ["id", *[F.col(c).cast("double").alias(c) for c in own]]
    left = scratch.write(points.where(sound("x", "y")).select(*both, _cell("x", side).alias("cx"), _cell("y", side).alias("cy")))
    ends = ("x1", "y1", "x2", "y2")
    drawn = lines.where(sound(*ends)).select("id", *[F.col(c).cast("double").alias(c) for c in ends])
    kinds = [df.schema["id"].dataType.simpleString() for df in (points, lines)]
    schema = f"id {kinds[0]}, {', '.join(f'{c} double' for c in own)}, line {kinds[1]}, x1 double, y1 double, x2 double, y2 double"
    found = None
    for pad in (radius / 8, radius):

        def run(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            if not len(p) or not len(s):
                return pd.DataFrame(columns=["id", *own, "line", *ends])
            turn = None if angle is None else np.arctan2(p["dy"].to_numpy(), p["dx"].to_numpy())
            i, k = nearest_of_tile(p[["x", "y"]].to_numpy(), turn, s[list(ends)].to_numpy(), pad, angle)
            return pd.concat([p[["id", *own]].iloc[i].reset_index(drop=True), s.rename(columns={"id": "line"})[["line", *ends]].iloc[k].reset_index(drop=True)], axis=1)

        tiles = scratch.write(left.groupBy("cx", "cy").agg(F.count("*").alias("np")))
        middle = [(F.col(c) + 0.5) * side for c in ("cx", "cy")]
        cells = line_cells(drawn, side, pad).where(geo.point_segment_distance(*middle, *[F.col(c) for c in ends]) <= (side * 0.7072 + pad) * (1 + 1e-9))
        # a crowded tile is dealt to several groups, each of which has a part of its points and of its lines
        share = lambda n: F.floor((F.col(n) - 1) / MOST_IN_TILE).cast("int")
        tiles = scratch.write(cells.groupBy("cx", "cy").agg(F.count("*").alias("nl")).join(tiles, ["cx", "cy"]).select("cx", "cy", share("np").alias("np"), share("nl").alias("nl")))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n)))
        one = lambda n: F.pmod(F.hash("id"), F.col(n) + 1)
        a = left.join(tiles, ["cx", "cy"]).withColumns({"p": one("np"), "l": each("nl")}).drop("np", "nl").groupBy("cx", "cy", "p", "l")
        b = cells.join(tiles, ["cx", "cy"]).withColumns({"p": each("np"), "l": one("nl")}).drop("np", "nl").groupBy("cx", "cy", "p", "l")
        pairs = a.cogroup(b).applyInPandas(run, schema)
        seg = [F.col(c) for c in ends]
        dist = geo.point_segment_distance(F.col("x"), F.col("y"), *seg)
        along = geo.along_segment(F.col("x"), F.col("y"), *seg) * F.hypot(seg[2] - seg[0], seg[3] - seg[1])
        if angle is not None:
            pairs = pairs.where(geo.undirected_angle(F.col("dx"), F.col("dy"), seg[2] - seg[0], seg[3] - seg[1]) <= angle)
        now = pairs.select("id", F.struct(dist.alias("dist"), "line", along.alias("along")).alias("m")).where(F.col("m.dist") <= pad)
        now = scratch.write(now.groupBy("id").agg(F.min("m").alias("m")))
        found = now if found is None else found.unionByName(now)
        if pad < radius:
            left = scratch.write(left.join(now.select("id"), "id", "left_anti"))
            if left.isEmpty():
                break
    return found.select("id", F.col("m.line").alias("line"), F.col("m.dist").alias("dist"), F.col("m.along").alias("along"))


def snap(points: DataFrame, nodes: DataFrame, lines: DataFrame, node_radius: float = 15.0, line_radius: float = 30.0, degree: int = 3) -> DataFrame:
    """(id, line, weight, dist, snap): points dealt to the segments of a network.

    A point within `node_radius` of a crossing (a node with `degree` lines or more) is
    shared evenly by the lines of the nearest; another one goes to the nearest line within
    `line_radius`; the rest have no row. Equal distances go to the smaller id. The weights
    of a point add up to 1. `nodes` has id, x, y and `lines` id, u, v and their ends.
    """
    ends = lines.select(F.col("u").alias("node"), "id").unionByName(lines.select(F.col("v").alias("node"), "id")).distinct()
    degrees = ends.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= degree)
    crossings = nodes.join(degrees, nodes["id"] == degrees["node"]).select("id", "x", "y", "n")
    at = nearest(points, crossings.select("id", "x", "y"), node_radius, limit=node_radius)
    shared = at.join(degrees, at["near_id"] == degrees["node"]).join(ends.withColumnRenamed("id", "line"), "node")
    shared = shared.select("id", "line", (1.0 / F.col("n")).alias("weight"), "dist", F.lit("node").alias("snap"))
    rest = points.join(at.select("id"), "id", "left_anti")
    best = nearest_lines(rest, lines, line_radius)
    alone = best.select("id", "line", F.lit(1.0).alias("weight"), "dist", F.lit("edge").alias("snap"))
    return shared.unionByName(alone)


def parallel_lines(targets: DataFrame, sources: DataFrame, radius: float = 20.0, angle: float = 30.0) -> DataFrame:
    """(id, source, dist): for each target segment the nearest source segment to its midpoint that runs along it.

    At most `radius` metres away and `angle` degrees apart, whichever way they are drawn.
    Equal distances go to the smaller source id. Targets without one have no row.
    """
    mids = targets.select(
        "id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"),
        (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"),
    )
    return nearest_lines(mids, sources, radius, angle).select("id", F.col("line").alias("source"), "dist")


def inherit_segments(edges: DataFrame, roads: DataFrame) -> DataFrame:
    """(id, seg): the road that each edge takes its segment from, by its kind; -1 for none.

    Roads within 15 m and 30 degrees, paths 25 m and 30 degrees, crossings 20 m at any angle.
    """
    found = None
    for kind, radius, angle in (("road", 15.0, 30.0), ("path", 25.0, 30.0), ("crossing", 20.0, 90.0)):
        one = parallel_lines(edges.where(F.col("kind") == kind), roads, radius, angle).select("id", F.col("source").alias("seg"))
        found = one if found is None else found.unionByName(one)
    return edges.select("id").join(found, "id", "left").withColumn("seg", F.coalesce("seg", F.lit(-1)))


def strongest_facility(targets: DataFrame, sources: list[DataFrame], radius: float = 20.0, angle: float = 30.0) -> DataFrame:
    """(id, facility): the highest class among the parallel lines of several sources; class 0 lines are ignored."""
    out = targets.select("id")
    names = []
    for i, s in enumerate(sources):
        real = s.where("facility > 0")
        got = parallel_lines(targets, real, radius, angle).join(real.select(F.col("id").alias("source"), "facility"), "source")
        names.append(f"f{i}")
        out = out.join(got.select("id", F.col("facility").alias(names[-1])), "id", "left")
    return out.select("id", F.greatest(F.lit(0), *[F.coalesce(n, F.lit(0)) for n in names]).alias("facility"))


def near_any(lines: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """`lines` with near: whether any point lies within `radius`."""
    hit = points_near_lines(points.select("x", "y"), lines.select("id", "x1", "y1", "x2", "y2"), radius).select("l.id").distinct()
    return lines.join(hit.withColumn("near", F.lit(True)), "id", "left").withColumn("near", F.coalesce("near", F.lit(False)))


def hex_bins(df: DataFrame, size: float) -> DataFrame:
    q, r = geo.hex_cell(F.col("x"), F.col("y"), size)
    return df.withColumns({"q": q, "r": r})


def ring_sums(cells: DataFrame, value: str) -> DataFrame:
    """(q, r, around): the sum over the six neighbours of each cell, its own value not counted."""
    ring = F.inline(F.array(*[F.struct((F.col("q") + dq).alias("q"), (F.col("r") + dr).alias("r")) for dq, dr in geo.RING]))
    sent = cells.select(F.col(value).alias("v"), ring).groupBy("q", "r").agg(F.sum("v").alias("around"))
    return cells.select("q", "r").join(sent, ["q", "r"], "left").withColumn("around", F.coalesce("around", F.lit(0)))


def corridor_points(paths: DataFrame, points: DataFrame, radius: float = 100.0, step: float = 20.0) -> DataFrame:
    """(id, n): different points within `radius` of samples at most `step` apart along each path's segments."""
    samples = paths.select("id", F.inline(geo.densify(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), step)))
    hits = within(samples, points.select(F.col("id").alias("point"), "x", "y"), radius).select("a.id", "b.point").distinct()
    counts = hits.groupBy("id").agg(F.count("*").alias("n"))
    return paths.select("id").distinct().join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def crossed_cells(paths: DataFrame, size: float) -> DataFrame:
    """(id, q, r): the hexagons of side `size` that the segments (id, x1, y1, x2, y2) of each path cross, each once a path.

    A path without a position crosses nothing.
    """
    sound = paths.where("x1 + y1 + x2 + y2 is not null")
    walked = geo.hex_walk(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")], size)
    return sound.select("id", F.inline(walked)).distinct()


def crossed_sums(paths: DataFrame, cells: DataFrame, value: str, size: float) -> DataFrame:
    """(id, n_cells, total) of each path: the hexagons it crosses, and the sum of `value` of `cells` (q, r, value) over them.

    A cell counts once, however often a path comes back to it; cells that are not there, and nulls, add nothing.
    """
    met = crossed_cells(paths, size).join(cells.select("q", "r", F.col(value).alias("__v")), ["q", "r"], "left")
    sums = met.groupBy("id").agg(F.count("*").alias("n_cells"), F.sum(F.coalesce("__v", F.lit(0))).alias("total"))
    out = paths.select("id").distinct().join(sums, "id", "left")
    return out.select("id", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("total", F.lit(0)).alias("total"))


def project_on_lines(points: DataFrame, lines: DataFrame, radius: float) -> DataFrame:
    """(id, line, along, offset): the nearest segment within `radius`, metres along it, and metres off it."""
    return nearest_lines(points, lines, radius).select("id", "line", "along", F.col("dist").alias("offset"))
