"""Paths over a network that trade time for risk."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from meridian.operators.edges import Kind, square_limit
from meridian.operators.graph import components_by_parts, connected_components
from meridian.operators.ranking import row_numbers
from meridian.operators.scoring import percentile_score
from meridian.operators.spatial import near_links
from meridian.plans.scratch import Scratch

# Weights of risk tried, most extra time, gains that make another path worth showing, search area.
LADDER = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0]
MAX_TIME_FACTOR, MAX_EXTRA_S = 1.25, 360.0
MIN_RISK_GAIN, MIN_EXPOSURE_GAIN = 10, 0.15
MAX_EXTRA_EXPOSURE, MIN_SIGNAL_GAIN = 0.10, 0.15
PAD_M, PAD_SHARE, MIN_TRIP_M = 1200.0, 0.6, 60.0
SPEEDS = {"walk": 1.3, "bike": 15 / 3.6, "ebike": 22 / 3.6, "scooter": 18 / 3.6}
#: Added to the cost of every edge, so that of equal paths the one with fewer edges wins.
PER_EDGE = 1e-9
#: How much longer than the cheapest straight line a path may be, at first and in later rounds; None: whatever lies in its box.
STRETCHES = [0.03, 0.15, 0.6, 2.4, None]


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge (eid, u, v) as src, dst in both directions, with reversed."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(*rest, F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(False).alias("reversed")).unionByName(
        edges.select(*rest, F.col("v").alias("src"), F.col("u").alias("dst"), F.lit(True).alias("reversed"))
    )


def cheapest_parallel(edges: DataFrame, cost: str) -> DataFrame:
    """One edge per (src, dst): the cheapest, the smallest eid of equals."""
    return edges.groupBy("src", "dst").agg(F.min(F.struct(cost, "eid")).alias("m")).select("src", "dst", F.col("m.eid").alias("eid"), F.col(f"m.{cost}").alias(cost))


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with index (gapless from 0, by id), and edges (u, v) with the indexes of their ends; edges with an unknown end are dropped."""
    numbered = Scratch(nodes.sparkSession).write(row_numbers(nodes.dropDuplicates(["id"]), [F.col("id")], "index").withColumn("index", F.col("index").cast("long") - 1))
    of = lambda end: numbered.select(F.col("id").alias(end), F.col("index").alias(f"{end}_index"))
    return numbered, edges.join(of("u"), "u").join(of("v"), "v")


def node_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): different edges at each node."""
    return edges.select(F.col("u").alias("node"), "eid").unionByName(edges.select(F.col("v").alias("node"), "eid")).distinct().groupBy("node").agg(F.count("*").alias("degree"))


def largest_component_share(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(share): rows of the largest component over all nodes (node); 0 without nodes. A node without a component is one alone."""
    sizes = nodes.join(components, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("n"))
    return sizes.agg((F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0))).alias("share"))


def distances(edges: DataFrame, sources: DataFrame, cost: str, limit: float | None = None, metric: bool = False) -> DataFrame:
    """(query, node, dist): least cost from each query's source, over any number of edges.

    Relaxes the edges of nodes that got closer in the last round, all queries at once, until
    none does. Costs must not be negative. `sources` has query and node. With `metric` the edges join all nodes at most
    `limit` apart by the straight line between them: then no way is shorter than an edge, and one round, in which nothing is
    relaxed from one node to the next, gives all distances.
    """
    if metric and limit is None:
        raise ValueError("metric needs a limit")
    scratch = Scratch(edges.sparkSession)
    best = scratch.write(sources.select("query", "node", F.lit(0.0).alias("dist")))
    front = best
    if limit is not None:
        edges = edges.where(F.col(cost) <= limit)  # a longer edge is on no way within the limit
    if metric:
        first = front.join(edges.select(F.col("src").alias("node"), "dst", cost), "node").select("query", F.col("dst").alias("node"), F.col(cost).alias("dist"))
        return best.unionByName(first).groupBy("query", "node").agg(F.min("dist").alias("dist"))
    while not front.isEmpty():
        step = front.join(edges.select(F.col("src").alias("node"), "dst", cost), "node")
        step = step.select("query", F.col("dst").alias("node"), (F.col("dist") + F.col(cost)).alias("new"))
        if limit is not None:
            step = step.where(F.col("new") <= limit)
        step = step.groupBy("query", "node").agg(F.min("new").alias("new"))
        closer = step.join(best, ["query", "node"], "left").where("dist is null or new < dist - 1e-12")
        front = scratch.write(closer.select("query", "node", F.col("new").alias("dist")))
        best = scratch.write(best.unionByName(front).groupBy("query", "node").agg(F.min("dist").alias("dist")))
    return best


def search_edges(queries: DataFrame, nodes: DataFrame, edges: DataFrame, cell: float = 1000.0) -> DataFrame:
    """Edges of each query's area: both ends in the box of its ends, padded by max(1200 m, 0.6 of the way).

    `queries` has query, origin, target, x1, y1, x2, y2. Boxes meet edges over square cells,
    an equi-join that copies a query to its cells.
    """
    pad = F.greatest(F.lit(PAD_M), PAD_SHARE * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    box = queries.select(
        "query", "origin", "target", (F.least("x1", "x2") - pad).alias("w"), (F.greatest("x1", "x2") + pad).alias("e"),
        (F.least("y1", "y2") - pad).alias("s"), (F.greatest("y1", "y2") + pad).alias("n"),
    )
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    cells = box.select("*", span("w", "e").alias("cx")).select("*", span("s", "n").alias("cy"))
    a, b = nodes.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")), nodes.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    placed = edges.join(a, "src").join(b, "dst").withColumns({"cx": F.floor(F.col("ax") / cell), "cy": F.floor(F.col("ay") / cell)})
    inside = " and ".join(f"{p}x between w and e and {p}y between s and n" for p in "ab")
    return placed.join(cells, ["cx", "cy"]).where(inside).select("query", "origin", "target", *edges.columns)


def cheapest_path(rows: list[tuple[int, int, int, float]], origin: int, target: int) -> list[int] | None:
    """Edge ids of the cheapest path over (src, dst, eid, cost), or None. Costs get 1e-9 so that fewer edges win."""
    found = _cheapest(rows, origin, target)
    return None if found is None else found[1]


def _cheapest(rows: list[tuple[int, int, int, float]], origin: int, target: int) -> tuple[float, list[int]] | None:
    """The cost of `cheapest_path` and the path."""
    out: dict[int, list[tuple[int, int, float]]] = {}
    for src, dst, eid, cost in rows:
        out.setdefault(src, []).append((dst, eid, cost + PER_EDGE))
    best, came = {origin: 0.0}, {}
    heap = [(0.0, origin)]
    while heap:
        d, u = heapq.heappop(heap)
        if u == target:
            path = []
            while u != origin:
                u, eid = came[u]
                path.append(eid)
            return d, path[::-1]
        if d > best[u]:
            continue
        for v, eid, c in out.get(u, ()):
            if d + c < best.get(v, float("inf")):
                best[v], came[v] = d + c, (u, eid)
                heapq.heappush(heap, (d + c, v))
    return None


def candidate_paths(area: DataFrame, time: str, risk: str, bar: float, ladder: list[float] | None = None, penalty: str | None = None) -> DataFrame:
    """(query, weight, pos, eid): for each query and weight of risk the cheapest path of its area.

    The cost of an edge is time * (1 + weight * risk / bar), times the column `penalty` if
    there is one; weight 0 is the fastest path. A query is a task's group, which gets the
    edges of its search area once for all weights; its size is that area, not the network.
    Queries without a path have no row; `plan_paths` looks for theirs in the whole network.
    """
    weights = [0.0, *(LADDER if ladder is None else ladder)]
    rows = area.select("query", "origin", "target", "src", "dst", "eid", time, F.coalesce(F.col(risk), F.lit(0.0)).alias("__risk"), (F.col(penalty) if penalty else F.lit(1.0)).alias("__penalty"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w in weights:
            f = g.assign(cost=g[time] * (1 + w * g["__risk"] / bar) * g["__penalty"]).sort_values(["cost", "eid"], kind="stable")
            path = cheapest_path(list(zip(f["src"], f["dst"], f["eid"], f["cost"])), g["origin"].iloc[0], g["target"].iloc[0])
            out += [(g["query"].iloc[0], w, i, e) for i, e in enumerate(path or [])]
        return pd.DataFrame(out, columns=["query", "weight", "pos", "eid"])

    return rows.groupBy("query").applyInPandas(run, "query long, weight double, pos int, eid long")


def reachable_edges(asks: DataFrame, nodes: DataFrame, placed: DataFrame, cell: float = 250.0) -> DataFrame:
    """(query, weight, origin, target, bound, src, dst, eid, cost): the edges that can be on a path of each ask that costs at most `bound`.

    No edge costs less than `rate` a metre of the straight line, so on such a path the straight ways to an edge and on from it, and the edge, cost `bound`
    or less. `asks` has query, weight, origin, target, x1, y1, x2, y2, rate and bound; without a bound all edges of the padded box are
    given. `placed` are edges with time, __risk, __penalty and the place (bx, by) of dst.
    """
    reach = F.try_divide("bound", "rate") * (1 + 1e-9) + 1e-6
    pad = F.greatest(F.lit(PAD_M), PAD_SHARE * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    low = lambda c: F.greatest(F.least(f"{c}1", f"{c}2") - pad, (F.col(f"{c}1") + F.col(f"{c}2") - reach) / 2)  # noqa: E731  # a null is left out
    high = lambda c: F.least(F.greatest(f"{c}1", f"{c}2") + pad, (F.col(f"{c}1") + F.col(f"{c}2") + reach) / 2)
    box = asks.select("*", reach.alias("reach"), low("x").alias("w"), high("x").alias("e"), low("y").alias("s"), high("y").alias("n"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    cells = box.select("*", span("w", "e").alias("cx")).select("*", span("s", "n").alias("cy"))
    at = nodes.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay")).withColumns({"cx": F.floor(F.col("ax") / cell), "cy": F.floor(F.col("ay") / cell)})
    away = lambda p, end: F.hypot(F.col(f"{p}x") - F.col(f"x{end}"), F.col(f"{p}y") - F.col(f"y{end}"))
    inside = lambda p: F.expr(f"{p}x between w and e and {p}y between s and n")
    near = at.join(cells.hint("merge"), ["cx", "cy"]).where(inside("a") & F.coalesce(away("a", 1) + away("a", 2) <= F.col("reach"), F.lit(True)))
    both = placed.join(near.drop("cx", "cy").hint("merge"), "src").withColumn("cost", _cost("weight"))
    both = both.where(inside("b") & F.coalesce(away("a", 1) + F.col("cost") / F.nullif("rate", F.lit(0.0)) + away("b", 2) <= F.col("reach"), F.lit(True)))
    return both.select("query", "weight", "origin", "target", "bound", "src", "dst", "eid", "cost")


def _cost(weight: str | float) -> Column:
    w = F.col(weight) if isinstance(weight, str) else F.lit(weight)
    return F.col("time") * (1 + w * F.col("__risk") / F.col("__bar")) * F.col("__penalty")


def bounded_paths(trips: DataFrame, nodes: DataFrame, edges: DataFrame, time: str, risk: str, bar: float, ladder: list[float] | None = None, penalty: str | None = None) -> tuple[DataFrame, DataFrame]:
    """`candidate_paths` over the padded box of each trip, and the trips (query, origin, target) that have no path there but may have one in the whole network.

    A trip and weight gets only the edges that can be on a path a little longer than the cheapest straight line. A path found among them within that bound is the
    cheapest of all; one found beyond it is the next round's bound, and where none is found, the bound grows, up to the whole box. Trips whose
    ends no path joins are dropped after the first round.
    """
    scratch, weights = Scratch(trips.sparkSession), [0.0, *(LADDER if ladder is None else ladder)]
    end = lambda p, to: nodes.select(F.col("id").alias(to), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    placed = edges.select("src", "dst", "eid", F.col(time).alias("time"), F.coalesce(F.col(risk), F.lit(0.0)).alias("__risk"), (F.col(penalty) if penalty else F.lit(1.0)).alias("__penalty"))
    placed = placed.join(end("a", "src"), "src").join(end("b", "dst"), "dst").withColumn("straight", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    placed = scratch.write(placed.drop("ax", "ay")).withColumn("__bar", F.lit(float(bar)))
    least = placed.where("straight > 0").agg(*[F.min(_cost(w) / F.col("straight")).alias(f"r{i}") for i, w in enumerate(weights)]).first()
    rates = [r if r is not None and r > 0 else 0.0 for r in least]
    weight = F.inline(F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(r).alias("rate")) for w, r in zip(weights, rates)]))
    asks = scratch.write(trips.select("query", "origin", "target", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], weight))
    left, found = asks.withColumn("total", F.lit(None).cast("double")), None

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["cost", "eid"], kind="stable")
        got = _cheapest(list(zip(g["src"].tolist(), g["dst"].tolist(), g["eid"].tolist(), g["cost"].tolist())), key[2], key[3])
        return pd.DataFrame([] if got is None else [(key[0], key[1], key[4], *got)], columns=["query", "weight", "bound", "total", "path"])

    for i, stretch in enumerate(STRETCHES):
        limit = F.lit(None).cast("double") if stretch is None else F.col("rate") * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * (1 + stretch)
        rows = reachable_edges(left.withColumn("bound", F.coalesce("total", F.when(F.col("rate") > 0, limit))), nodes, placed)
        tried = rows.groupBy("query", "weight", "origin", "target", "bound").applyInPandas(run, "query long, weight double, bound double, total double, path array<long>")
        tried = scratch.write(tried.withColumn("sure", F.expr("bound is null or isnan(bound) or total <= bound")))
        now = tried.where("sure").select("query", "weight", "path")
        found = now if found is None else found.unionByName(now)
        left = asks.join(found.select("query", "weight"), ["query", "weight"], "left_anti").join(tried.where("not sure").select("query", "weight", "total"), ["query", "weight"], "left")
        left = scratch.write(left)
        if left.isEmpty():
            break
        if i == 0:
            part = connected_components(placed, "src", "dst")
            of = lambda c: part.toDF(c, f"{c}_part")
            asks = scratch.write(asks.join(of("origin"), "origin").join(of("target"), "target").where("origin_part = target_part").drop("origin_part", "target_part"))
            left = scratch.write(left.join(asks.select("query", "weight"), ["query", "weight"], "left_semi"))
            if left.isEmpty():
                break
    found = found.select("query", "weight", F.posexplode("path").alias("pos", "eid"))
    return found, left.select("query", "origin", "target").distinct().join(found.select("query").distinct(), "query", "left_anti")


#: The cost of edges of given lengths and kinds under a weight of risk; it goes with the length and is not negative.
EdgeCost = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def path_among(ids: np.ndarray, xy: np.ndarray, origin: int, target: int, radius: float, rate: float, cost: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[float, list[int]] | None:
    """The cost of the cheapest path from `origin` to `target` over edges between nodes at most `radius` apart, and its nodes; None without one.

    `ids` ascend. `cost` tells of edges (u, v, length), u < v, and is at least `rate` a metre. The edges of a node are made when it is its
    turn, and nodes take turns by what a path over them must cost at least, so most of the edges are never made.
    """
    a, b = np.searchsorted(ids, [origin, target])
    x, y, limit = xy[:, 0], xy[:, 1], square_limit(radius)
    ahead = rate * np.hypot(x - x[b], y - y[b])
    best, least, came = np.full(len(ids), np.inf), np.full(len(ids), np.inf), np.full(len(ids), -1)
    best[a], least[a] = 0.0, ahead[a]
    while True:
        i = int(np.argmin(least))
        if not least[i] < np.inf:
            return None
        if i == b:
            break
        least[i] = np.inf
        dx, dy = x - x[i], y - y[i]
        k = np.flatnonzero((dx * dx + dy * dy <= limit) & (best > best[i]))
        u, v = np.minimum(ids[i], ids[k]), np.maximum(ids[i], ids[k])
        new = best[i] + (cost(u, v, np.hypot(dx[k], dy[k])) + PER_EDGE)
        closer = new < best[k]
        k = k[closer]
        best[k], came[k] = new[closer], i
        least[k] = best[k] + ahead[k]
    path = [int(b)]
    while path[-1] != a:
        path.append(int(came[path[-1]]))
    return float(best[b]), [int(ids[i]) for i in path[::-1]]


def near_paths(trips: DataFrame, nodes: DataFrame, radius: float, kind: Kind, cost: EdgeCost, kinds: list[int], whole: Callable[[DataFrame], DataFrame], ladder: list[float] | None = None, cell: float = 50.0) -> DataFrame:
    """`plan_paths` over the network that joins all `nodes` (id, x, y) at most `radius` apart: (query, weight, pos, u, v), u < v. No edge is written or shuffled.

    Edges grow with the square of the nodes, so a trip gets only the nodes that a path within its bound can use, and makes their edges as it needs them
    (`path_among`); the bounds are those of `bounded_paths`. `kinds` are those that occur (`kind_counts`). `whole` finds the
    paths (query, weight, pos, u, v) of trips that have none in their padded box but are joined all the same.
    """
    scratch, weights = Scratch(trips.sparkSession), [0.0, *(LADDER if ladder is None else ladder)]
    rates = [min((float(cost(np.ones(1), np.array([k]), w)[0]) for k in kinds), default=0.0) * (1 - 1e-12) for w in weights]
    weight = F.inline(F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(r).alias("rate")) for w, r in zip(weights, rates)]))
    go = trip_guards(trips).where("status = 'ok'")
    asks = scratch.write(go.select("query", "origin", "target", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], weight))
    sound = "abs(x) < double('infinity') and abs(y) < double('infinity')"  # neither null nor NaN
    at = nodes.where(sound).select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    at = scratch.write(at.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)}))

    def run(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near, out = near.sort_values("id"), []
        ids, xy = near["id"].to_numpy(), near[["x", "y"]].to_numpy()
        for r in asked.itertuples():
            of = lambda u, v, length: cost(length, kind(u, v), r.weight)  # noqa: B023, E731
            got = path_among(ids, xy, r.origin, r.target, radius, r.rate, of) if np.isin([r.origin, r.target], ids).all() else None
            if got is not None:
                out.append((r.query, r.weight, r.bound, *got))
        return pd.DataFrame(out, columns=["query", "weight", "bound", "total", "nodes"])

    left, found = asks.withColumn("total", F.lit(None).cast("double")), None
    for i, stretch in enumerate(STRETCHES):
        limit = F.lit(None).cast("double") if stretch is None else F.col("rate") * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * (1 + stretch)
        now = left.withColumn("bound", F.coalesce("total", F.when(F.col("rate") > 0, limit)))
        # the furthest reach of a trip's weights; a null or none goes as far as the box
        reach = F.coalesce(F.try_divide("bound", "rate") * (1 + 1e-9) + 1e-6, F.lit(float("inf")))
        area = now.groupBy("query", "x1", "y1", "x2", "y2").agg(F.max(reach).alias("reach"))
        pad = F.greatest(F.lit(PAD_M), PAD_SHARE * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
        low = lambda c: F.greatest(F.least(f"{c}1", f"{c}2") - pad, (F.col(f"{c}1") + F.col(f"{c}2") - F.col("reach")) / 2)
        high = lambda c: F.least(F.greatest(f"{c}1", f"{c}2") + pad, (F.col(f"{c}1") + F.col(f"{c}2") + F.col("reach")) / 2)
        box = area.select("*", low("x").alias("w"), high("x").alias("e"), low("y").alias("s"), high("y").alias("n"))
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
        cells = box.select("*", span("w", "e").alias("cx")).select("*", span("s", "n").alias("cy"))
        away = lambda end: F.hypot(F.col("x") - F.col(f"x{end}"), F.col("y") - F.col(f"y{end}"))
        near = at.join(cells.hint("merge"), ["cx", "cy"]).where("x between w and e and y between s and n").where(away(1) + away(2) <= F.col("reach")).select(F.col("query").alias("trip"), "id", "x", "y")
        tried = now.groupBy("query").cogroup(near.groupBy("trip")).applyInPandas(run, "query long, weight double, bound double, total double, nodes array<long>")
        tried = scratch.write(tried.withColumn("sure", F.expr("bound is null or isnan(bound) or total <= bound")))
        sure = tried.where("sure").select("query", "weight", "nodes")
        found = sure if found is None else found.unionByName(sure)
        left = asks.join(found.select("query", "weight"), ["query", "weight"], "left_anti").join(tried.where("not sure").select("query", "weight", "total"), ["query", "weight"], "left")
        left = scratch.write(left)
        if left.isEmpty():
            break
        if i == 0:
            part = components_by_parts(near_links(at, radius))
            of = lambda c: part.toDF(c, f"{c}_part")
            asks = scratch.write(asks.join(of("origin"), "origin").join(of("target"), "target").where("origin_part = target_part").drop("origin_part", "target_part"))
            left = scratch.write(left.join(asks.select("query", "weight"), ["query", "weight"], "left_semi"))
            if left.isEmpty():
                break
    ends = lambda i: (F.get("nodes", F.col("pos")), F.get("nodes", F.col("pos") + 1))[i]
    steps = found.select("query", "weight", "nodes", F.explode(F.sequence(F.lit(0), F.size("nodes") - 2)).alias("pos"))
    out = steps.select("query", "weight", "pos", F.least(ends(0), ends(1)).alias("u"), F.greatest(ends(0), ends(1)).alias("v"))
    lost = scratch.write(left.select("query", "origin", "target").distinct().join(found.select("query").distinct(), "query", "left_anti"))
    return out if lost.isEmpty() else out.unionByName(whole(lost))


def network_paths(trips: DataFrame, edges: DataFrame, time: str, risk: str, bar: float, ladder: list[float] | None = None, penalty: str | None = None) -> DataFrame:
    """`candidate_paths` over the whole network: (query, weight, pos, eid) of trips (query, origin, target).

    Each round relaxes the edges of the nodes that got closer in the one before, for all trips
    and weights at once, and keeps how each node was reached; the paths are then followed back
    from the targets, an edge a round. No task holds a network or a trip.
    """
    spark = trips.sparkSession
    scratch = Scratch(spark)
    cost = F.col(time) * (1 + F.col("weight") * F.coalesce(F.col(risk), F.lit(0.0)) / bar) * (F.col(penalty) if penalty else F.lit(1.0)) + PER_EDGE
    links = edges.select(F.col("src").alias("node"), "dst", "eid", time, risk, *([penalty] if penalty else []))
    asked = trips.select("query", "origin", "target", F.explode(F.array(*map(F.lit, [0.0, *(LADDER if ladder is None else ladder)]))).alias("weight"))
    best = scratch.write(asked.select("query", "weight", F.col("origin").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("eid"), F.lit(None).cast("long").alias("prev")))
    front = best
    while not front.isEmpty():
        step = front.select("query", "weight", "node", "dist").join(links, "node")
        step = step.select("query", "weight", F.col("dst").alias("node"), F.struct((F.col("dist") + cost).alias("dist"), "eid", F.col("node").alias("prev")).alias("m"))
        step = step.groupBy("query", "weight", "node").agg(F.min("m").alias("m")).select("query", "weight", "node", "m.*")
        known = best.select("query", "weight", "node", F.col("dist").alias("__had"))
        front = scratch.write(step.join(known, ["query", "weight", "node"], "left").where("__had is null or dist < __had - 1e-12").drop("__had"))
        both = best.unionByName(front).groupBy("query", "weight", "node").agg(F.min(F.struct("dist", "eid", "prev")).alias("m"))
        best = scratch.write(both.select("query", "weight", "node", "m.*"))
    at, found, n = asked.select("query", "weight", F.col("target").alias("node")), None, 0
    while True:
        step = scratch.write(at.join(best, ["query", "weight", "node"]).where("eid is not null").select("query", "weight", "prev", "eid", F.lit(n).alias("back")))
        found = step if found is None else found.unionByName(step)
        if step.isEmpty():
            break
        at, n = step.select("query", "weight", F.col("prev").alias("node")), n + 1
    w = Window.partitionBy("query", "weight").orderBy(F.desc("back"))
    return found.select("query", "weight", (F.row_number().over(w) - 1).alias("pos"), F.col("eid").cast("long").alias("eid"))


def trip_guards(trips: DataFrame) -> DataFrame:
    """`trips` (query, origin, target, x1, y1, x2, y2) with status: too_close if both ends are one node or under 60 m apart, else ok."""
    near = (F.col("origin") == F.col("target")) | (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) < MIN_TRIP_M)
    return trips.withColumn("status", F.when(near, "too_close").otherwise("ok"))


def plan_paths(trips: DataFrame, nodes: DataFrame, edges: DataFrame, time: str, risk: str, bar: float, ladder: list[float] | None = None, penalty: str | None = None) -> DataFrame:
    """(query, weight, pos, eid) of all trips that are far enough: in their padded box (`bounded_paths`), or else in the whole network.

    `edges` are directed (`both_ways`). Trips that no path joins at all have no row.
    """
    go = trip_guards(trips).where("status = 'ok'")
    scratch = Scratch(trips.sparkSession)
    columns = [time, risk, *([penalty] if penalty else [])]
    slim = edges.select("src", "dst", "eid", *columns)
    boxed, lost = bounded_paths(go, nodes, slim, time, risk, bar, ladder, penalty)
    if lost.isEmpty():
        return boxed
    return boxed.unionByName(network_paths(scratch.write(lost), slim, time, risk, bar, ladder, penalty))


def timed_densities(paths: DataFrame, edges: DataFrame, departs: DataFrame, by_hour: DataFrame) -> DataFrame:
    """(query, weight, pos, eid, log_density): each step's density at the hour in which its middle is passed.

    `edges` has eid and time, `departs` query and depart, `by_hour` eid, hour and log_density.
    A step without a density for its hour has null. `by_hour` may have 24 rows for each of an edge's, whose size
    Spark can't tell from its file, so it is merged and not broadcast.
    """
    steps = paths.join(edges.select("eid", "time"), "eid")
    w = Window.partitionBy("query", "weight").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("at", F.coalesce(F.sum("time").over(w), F.lit(0.0)) + F.col("time") / 2).join(departs, "query")
    passed = F.hour(F.timestamp_micros(F.unix_micros(F.col("depart").cast("timestamp")) + (F.col("at") * 1_000_000).cast("long")))
    return steps.withColumn("hour", passed).join(by_hour.hint("merge"), ["eid", "hour"], "left").select("query", "weight", "pos", "eid", "log_density")


def measure_paths(paths: DataFrame, edges: DataFrame, high: int = 75, away: float = 0.0, q: DataFrame | None = None) -> DataFrame:
    """(query, weight, duration, length, exposure, log_mean, risk, high_m, signal_m, path) of each path.

    `edges` has eid, time, length, log_density and score once per edge, and perhaps penalty;
    `paths` may bring its own log_density, as `timed_densities` gives it. Steps without a
    density count as `away`. exposure is the sum of exp(log_density) per 100 m, log_mean the
    log of the mean density by length and risk its whole score on the quantile table `q` (one
    row), null without one. signal_m is the length times what penalties exceed one, path a
    hash of the edges in order.
    """
    columns = ["time", "length", "score", *[c for c in ("log_density", "penalty") if c in edges.columns and c not in paths.columns]]
    steps = paths.join(edges.select("eid", *columns), "eid")
    d = F.exp(F.coalesce("log_density", F.lit(away))) * F.col("length")
    extra = (F.col("penalty") - 1) * F.col("length") if "penalty" in columns else F.lit(0.0)
    out = steps.groupBy("query", "weight").agg(
        F.sum("time").alias("duration"), F.sum("length").alias("length"), (F.sum(d) / 100).alias("exposure"), F.ln(F.sum(d) / F.sum("length")).alias("log_mean"),
        F.sum(F.when(F.col("score") >= high, F.col("length")).otherwise(0.0)).alias("high_m"), F.sum(extra).alias("signal_m"), F.bit_xor(F.xxhash64("pos", "eid")).alias("path"),
    )
    if q is None:
        return out.withColumn("risk", F.lit(None).cast("int"))
    return out.join(F.broadcast(q)).withColumn("risk", F.rint(percentile_score(F.col("log_mean"), F.col("q"))).cast("int")).drop("q")


def _least(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """(query, name): for each query the struct of the row that comes first by `by` and then by weight."""
    kept = ["weight", "duration", "length", "exposure", "risk", "signal_m", "path"]
    return rows.groupBy("query").agg(F.min_by(F.struct(*kept), F.struct(*by, "weight")).alias(name))


def decide(measured: DataFrame, long_m: float = 3000.0, long_s: float = 2400.0) -> DataFrame:
    """(query, weight, status, duration, exposure, t0, e0, tradeoff_s, shown): the path to take, and what to say of it.

    Of the paths that take at most 1.25 times and 6 minutes more than the fastest (weight 0),
    the one with the least exposure is shown if it is another path and gains 10 points of
    risk or 15 % of exposure; else the fastest is. tradeoff_s is the extra time of the path
    with the least exposure at all, if that would gain 15 % more. status is long_trip for
    trips whose fastest path is longer than `long_m` or `long_s`, fastest_is_lower_risk where
    that is taken, tradeoff_exists where more time would gain more, else ok.
    """
    fastest = measured.where("weight = 0").select("query", F.struct("duration", "length", "exposure", "risk", "path").alias("f"))
    tried = measured.where("weight > 0").join(fastest, "query")
    within = tried.where(F.col("duration") <= F.least(MAX_TIME_FACTOR * F.col("f.duration"), F.col("f.duration") + MAX_EXTRA_S) + 1e-6)
    got = fastest.join(_least(within, ["exposure", "duration"], "b"), "query", "left").join(_least(tried, ["exposure", "duration"], "o"), "query", "left")
    had, best = F.coalesce("b.exposure", "f.exposure"), F.col("b")
    sure = lambda c: F.coalesce(c, F.lit(False))
    gains = sure(F.col("f.risk") - best["risk"] >= MIN_RISK_GAIN) | sure(best["exposure"] <= F.col("f.exposure") * (1 - MIN_EXPOSURE_GAIN))
    shown = sure(best["path"] != F.col("f.path")) & gains
    tradeoff = F.when(F.col("o.exposure") <= had * (1 - MIN_EXPOSURE_GAIN), F.col("o.duration") - F.col("f.duration"))
    far = (F.col("f.length") > long_m) | (F.col("f.duration") > long_s)
    got = got.withColumns({"shown": shown, "tradeoff_s": tradeoff})
    status = F.when(far, "long_trip").when(~F.col("shown"), "fastest_is_lower_risk").when(F.coalesce(F.col("tradeoff_s") > 0, F.lit(False)), "tradeoff_exists").otherwise("ok")
    pick = lambda c, of: F.when(F.col("shown"), best[c]).otherwise(of)
    return got.select(
        "query", pick("weight", F.lit(0.0)).alias("weight"), status.alias("status"), pick("duration", F.col("f.duration")).alias("duration"), pick("exposure", F.col("f.exposure")).alias("exposure"),
        F.col("f.duration").alias("t0"), F.col("f.exposure").alias("e0"), "tradeoff_s", "shown",
    )


def decide_lit(measured: DataFrame, lit: DataFrame, **limits: float) -> DataFrame:
    """`decide`, with lit: whether a better lit or busier path takes the place of what it shows.

    `lit` are paths under penalties (`plan_paths` with a penalty), measured like the others.
    One that keeps to the time budget and has at most 10 % more exposure than the fastest, and
    the least signal_m of those, is taken if it is another path than the fastest and than what
    is shown, and cuts the latter's signal_m by 15 %.
    """
    default = decide(measured, **limits)
    of = measured.select("query", "weight", F.col("signal_m").alias("had_m"), F.col("path").alias("had_path"))
    fastest = measured.where("weight = 0").select("query", F.col("path").alias("fast_path"))
    base = default.join(of, ["query", "weight"]).join(fastest, "query")
    within = lit.join(base.select("query", "t0", "e0"), "query")
    within = within.where((F.col("duration") <= F.least(MAX_TIME_FACTOR * F.col("t0"), F.col("t0") + MAX_EXTRA_S) + 1e-6) & (F.col("exposure") <= F.col("e0") * (1 + MAX_EXTRA_EXPOSURE)))
    got = base.join(_least(within, ["signal_m", "exposure", "duration"], "l"), "query", "left")
    other = (F.col("l.path") != F.col("fast_path")) & (F.col("l.path") != F.col("had_path"))
    better = F.coalesce(other & (F.col("had_m") > 0) & (F.col("l.signal_m") <= F.col("had_m") * (1 - MIN_SIGNAL_GAIN)), F.lit(False))
    got = got.withColumn("lit", better)
    pick = lambda c: F.when(F.col("lit"), F.col(f"l.{c}")).otherwise(F.col(c)).alias(c)
    status = F.when(F.col("lit") & (F.col("status") != "long_trip"), "ok").otherwise(F.col("status")).alias("status")
    tradeoff = F.when(~F.col("lit"), F.col("tradeoff_s")).alias("tradeoff_s")
    return got.select("query", pick("weight"), status, pick("duration"), pick("exposure"), "t0", "e0", tradeoff, (F.col("shown") | F.col("lit")).alias("shown"), "lit")


def answer_trips(trips: DataFrame, decided: DataFrame) -> DataFrame:
    """Every trip with its status: too_close, no_connection, or what was decided of it."""
    guarded = trip_guards(trips).select("query", F.col("status").alias("__guard"))
    status = F.when(F.col("__guard") == "too_close", "too_close").otherwise(F.coalesce("status", F.lit("no_connection")))
    return guarded.join(decided, "query", "left").withColumn("status", status).drop("__guard")


def traversal_offsets(steps: DataFrame, path: str, time: str) -> DataFrame:
    """`steps` (path, pos) with at: seconds from the start to the middle of each step."""
    w = Window.partitionBy(path).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("at", F.coalesce(F.sum(time).over(w), F.lit(0.0)) + F.col(time) / 2)


def shared_names(a: Column, b: Column) -> Column:
    """Names in both lists, sorted."""
    return F.array_sort(F.array_intersect(a, b))


def avoided_names(fastest: Column, chosen: Column) -> Column:
    """Names on the fastest path that the chosen one does not have, sorted."""
    return F.array_sort(F.array_except(fastest, chosen))
