"""Faults found in round 4."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from meridian.operators import graph, ingest

T0 = datetime(2024, 1, 1)
EVENTS = "id long, x double, y double, ts timestamp, collision_id string"


def joined(pairs, nodes):
    least = {n: n for n in nodes}
    while moved := [(a, b) for a, b in pairs if least[a] != least[b]]:
        for a, b in moved:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_copies_are_chained_and_not_paired(spark):
    rng = random.Random(2)
    places = [(rng.uniform(0, 90), rng.uniform(0, 9), rng.randrange(9000)) for _ in range(30)] + [(float("nan"), 1.0, 0), (float("inf"), 1.0, 0)]
    rows = [(100 * k + i, x, y, T0 + timedelta(seconds=t), "c" if i == 3 and k < 2 else None) for i, (x, y, t) in enumerate(places) for k in range(12)]
    events = spark.createDataFrame(rows, EVENTS)
    links = ingest.cluster_links(events).collect()
    pairs = ingest.duplicate_links(events.where("abs(x) < 1e9")).collect()
    ids = [r[0] for r in rows]
    assert joined([tuple(r) for r in links], ids) == joined([tuple(r) for r in pairs], ids)
    assert len(links) < 2 * len(rows) < len(pairs)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_by_parts_equal_the_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(few)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(999, 500 + i) for i in range(40)] + [(7, 7), (None, 3)]
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(5)
    got = sorted(tuple(r) for r in graph.components_by_parts(edges).collect())
    assert got == sorted(tuple(r) for r in graph.connected_components(edges).collect())


def test_stars_of_a_partition_are_no_more_than_its_nodes():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 500, (2, 20_000))
    nodes, least = graph.least_reachable(u, v)
    assert len(nodes) == 500 and (least == 0).all()
    chain = rng.permutation(2000)
    assert (graph.least_reachable(chain[:-1], chain[1:])[1] == 0).all()


def test_stream_keeps_one_copy_of_a_place(spark):
    """State and links of copies grow with the copies, not with their square."""
    from meridian.streaming import late

    near = late._Near(20.0, 1800, 1, chain=True)
    held, found, kept = {0: ([], [], [], [], []), -1: ([], [], [], [], []), 1: ([], [], [], [], [])}, [], {}
    for i in range(50):
        found += list(near._near(held, kept, i, 5.0, 5.0, 100, True))
    found += list(near._near(held, kept, 50, 6.0, 5.0, 100, True))
    assert found == [(0, i) for i in range(1, 50)] + [(0, 50)] and len(held[0][0]) == 2


def test_paths_among_points_equal_those_over_edges(spark):
    from pyspark.sql import functions as F

    from meridian.operators import edges as near, routing, scoring
    from meridian.plans import q_space

    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 60), rng.gauss(0, 60)) for i in range(90)] + [(90, 900.0, 0.0), (91, None, 0.0)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double")
    at = {r[0]: r[1:] for r in rows}
    trips = spark.createDataFrame([(i, a, b, *at[a], *at[b]) for i, (a, b) in enumerate([(0, 50), (3, 71), (8, 90), (12, 12)])], "query long, origin long, target long, x1 double, y1 double, x2 double, y2 double")
    pairs = [(u, v, np.hypot(at[u][0] - at[v][0], at[u][1] - at[v][1])) for u in range(91) for v in range(u + 1, 91)]
    edges = spark.createDataFrame([(u * 1_000_000 + v, u, v, float(c)) for u, v, c in pairs if c <= 50], "eid long, u long, v long, length double")
    edges = q_space._attributes(edges).cache()
    counts = near.kind_counts(nodes, 50.0, q_space._kind).collect()
    assert {r["kind"]: r["n"] for r in counts} == {r[0]: r["count"] for r in edges.groupBy(F.col("eid") % 195).count().collect()}
    told = spark.createDataFrame([(r["kind"] % 13 / 4 - 2, r["n"]) for r in counts], "v double, n long")
    assert scoring.quantile_table(told, "v", times="n").first() == scoring.quantile_table(edges, "log_density").first()
    kinds = [r["kind"] for r in counts]
    got = routing.near_paths(trips, nodes, 50.0, q_space._kind, q_space._lit_cost, kinds, lambda lost: pytest.fail("a trip was lost"), [0.5, 4.0])
    want = routing.plan_paths(trips, nodes, routing.both_ways(edges.select("eid", "u", "v", "time", "risk", "penalty")), "time", "risk", 1.0, [0.5, 4.0], penalty="penalty")
    assert sorted((r["query"], r["weight"], r["pos"], r["u"] * 1_000_000 + r["v"]) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_bounded_paths_shuffle_no_edges(spark, duck, monkeypatch):
    from conftest import same_as_sql
    from meridian.plans import q_space

    monkeypatch.setattr(q_space, "network", lambda *a: pytest.fail("edges were made"))
    same_as_sql(spark, duck, q_space.bounded_paths, q_space.Q.sql["bounded_paths"])


def test_the_nearest_edge_is_found_without_making_all():
    from meridian.operators import edges as near

    rng = np.random.default_rng(3)
    for trial in range(60):
        xy = rng.normal(0, 40, (60, 2))
        xy[50:] = xy[:10]  # two at one place
        q = xy[5] + (0 if trial % 3 == 0 else rng.normal(0, 30, 2) if trial % 3 == 1 else 1e-3)
        ids = rng.permutation(60)
        a, b = np.triu_indices(60, 1)
        d = xy[b] - xy[a]
        ok = np.hypot(*d.T) <= 50
        a, b, d = a[ok], b[ok], d[ok]
        square = (d * d).sum(1)
        t = np.clip(((q - xy[a]) * d).sum(1) / np.where(square == 0, 1, square), 0, 1)
        dist = np.hypot(*(q - xy[a] - t[:, None] * d).T)
        want = {tuple(sorted((ids[i], ids[k]))) for i, k, s in zip(a, b, dist) if s <= 30 and s == dist.min()}
        got = {(ids[i], ids[k]) for i, k in zip(*near.edges_at(q, ids, xy, 50.0, 30.0))}
        assert want <= got and all(i < k for i, k in got) and (len(want) == 0 or len(got) < len(a) / 2)


@pytest.mark.parametrize("name", ["project_on_lines", "snap_split_weights"])
def test_nearest_edges_shuffle_no_edges(spark, duck, monkeypatch, name):
    from conftest import same_as_sql
    from meridian.plans import q_space

    monkeypatch.setattr(q_space, "network", lambda *a: pytest.fail("edges were made"))
    same_as_sql(spark, duck, q_space.Q.queries[name], q_space.Q.sql[name])


def test_a_rim_is_tested_by_cells(spark, monkeypatch):
    from pyspark.sql import functions as F

    from meridian.functions import geo
    from meridian.operators import cover

    rng = random.Random(6)
    star = lambda x, y, a, n: [(x + a * (1 + k % 2) * np.cos(2 * np.pi * k / n), y + a * (1 + k % 2) * np.sin(2 * np.pi * k / n)) for k in [*range(n), 0]]
    rows = [(i, [star(x, y, 2.0, 8), *([star(x, y, 0.5, 4)] if i % 2 else [])]) for i in range(12) for x, y in [(rng.uniform(0, 9), rng.uniform(0, 9))]]
    rows += [(50, [[(1.0, 1.0), (2.0, 2.0)]]), (51, [[(1.0, 1.0), (None, 8.0), (9.0, 4.0), (1.0, 1.0)]]), (52, None)]
    polygons = spark.createDataFrame([(i, r and [[(float(x) if x is not None else None, float(y)) for x, y in q] for q in r]) for i, r in rows], "id long, rings array<array<struct<x double, y double>>>")
    points = spark.createDataFrame([(i, rng.uniform(-2, 11), rng.uniform(-2, 11)) for i in range(300)], "id long, x double, y double")
    want = {tuple(r) for r in points.join(polygons.withColumnRenamed("id", "polygon")).where(geo.in_polygon(F.col("x"), F.col("y"), F.col("rings"))).select("id", "polygon").collect()}
    monkeypatch.setattr(geo, "in_polygon", lambda *a: pytest.fail("pairs were tested row by row"))
    monkeypatch.setattr(cover, "MOST_PAIRS", 20)  # so that cells are shared
    got = [tuple(r) for r in cover.points_in_polygons(points, polygons, 1.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
