"""Cells of polygons and paths, and thinning by rounds, against brute force."""

import math
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import cover, safety, spatial, trips

POLYGON = "id long, rings array<array<struct<x:double,y:double>>>"
POINT = "id long, x double, y double"


def in_ring(x, y, ring):
    return len(ring) >= 4 and sum((b[1] > y) != (a[1] > y) and x < (a[0] - b[0]) * (y - b[1]) / (a[1] - b[1]) + b[0] for a, b in pairwise(ring)) % 2 == 1


def in_polygon(x, y, rings):
    return bool(rings) and in_ring(x, y, rings[0]) and not any(in_ring(x, y, r) for r in rings[1:])


def star(rng, x, y, far, n):
    ring = [(x + far * rng.uniform(0.2, 1) * math.cos(2 * math.pi * i / n), y + far * rng.uniform(0.2, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*ring, ring[0]]


def square(x, y, far):
    return [(float(x + i * far), float(y + j * far)) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]


@pytest.mark.parametrize("size", [0.7, 1.0, 5.0, 40.0])
def test_points_meet_polygons(spark, size):
    rng = random.Random(7)
    polygons = [(i, [star(rng, rng.uniform(-10, 10), rng.uniform(-10, 10), rng.uniform(0.3, 9), rng.randrange(3, 12))]) for i in range(20)]
    polygons += [(20, [square(0, 0, 6), square(1, 1, 2), square(-3, -3, 1)]), (21, [square(5, 5, 5)]), (22, [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]), (23, []), (24, [square(-4, 3, 0.01)])]
    points = [(i, rng.uniform(-15, 15), rng.uniform(-15, 15)) for i in range(400)]
    points += [(400 + i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(-1, 11, 1) for y in range(-1, 11, 1))]  # on corners, edges and cell borders
    points += [(900, None, 0.0), (901, float("nan"), 0.0), (902, float("inf"), 0.0), (903, -4.0, 3.0)]
    got = cover.points_in_polygons(spark.createDataFrame(points, POINT), spark.createDataFrame(polygons + [(25, None)], POLYGON), size).collect()
    expected = {(i, k) for i, x, y in points if i < 900 or i == 903 for k, rings in polygons if in_polygon(x, y, rings)}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == expected
    assert len({k for _, k in expected}) > 15


def test_most_points_need_no_exact_test(spark):
    cells = cover.cover(spark.createDataFrame([(1, [square(0, 0, 50)])], POLYGON), 1.0)
    count = {r["whole"]: r["count"] for r in cells.groupBy("whole").count().collect()}
    assert count[True] >= 98 * 98 and count[False] <= 4 * 102 * 2
    assert cells.groupBy("id", "cx", "cy").count().where("count > 1").count() == 0


def test_hexes_by_their_centres(spark):
    rng = random.Random(3)
    polygons = [(i, [star(rng, rng.uniform(-10, 10), rng.uniform(-10, 10), 8.0, 7)]) for i in range(6)] + [(6, [square(0, 0, 9), square(0, 0, 3)])]
    got = {tuple(r) for r in cover.hexes_in_polygons(spark.createDataFrame(polygons, POLYGON), 0.9).collect()}
    expected = set()
    for q in range(-60, 60):
        for r in range(-40, 40):
            x, y = 0.9 * math.sqrt(3) * (q + r / 2), 0.9 * 1.5 * r
            expected |= {(k, q, r) for k, rings in polygons if in_polygon(x, y, rings)}
    assert got == expected and len(got) > 300
    assert cover.hexes_in_polygons(spark.createDataFrame([], POLYGON), 1.0).count() == 0


def hexagon(x, y, size):
    q, r = (x * math.sqrt(3) / 3 - y / 3) / size, y * 2 / 3 / size
    s = -q - r
    rq, rr, rs = round(q), round(r), round(s)
    dq, dr, ds = abs(rq - q), abs(rr - r), abs(rs - s)
    if dq > dr and dq > ds:
        rq = -rr - rs
    elif dr > ds:
        rr = -rq - rs
    return rq, rr


LINE = "id long, x1 double, y1 double, x2 double, y2 double"


def test_paths_cross_each_cell_once(spark):
    rng = random.Random(9)
    lines = [(i % 30, *(rng.uniform(-20, 20) for _ in range(4))) for i in range(60)] + [(30, 1.0, 1.0, 1.0, 1.0), (31, 0.0, 0.0, 0.0, 12.0), (32, -9.0, 0.0, 9.0, 0.0), (33, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(lines, LINE)
    rows = [tuple(r) for r in spatial.crossed_cells(df, 1.3).collect()]
    assert len(rows) == len(set(rows))
    got, sampled = set(rows), set()
    for i, x1, y1, x2, y2 in lines[:-1]:
        sampled |= {(i, *hexagon(x1 + (x2 - x1) * k / 4000, y1 + (y2 - y1) * k / 4000, 1.3)) for k in range(1, 4000)}
    # samples can miss a corner, and on an edge between two cells either counts
    along_an_edge = {31, 32}
    assert {c for c in sampled if c[0] not in along_an_edge} <= got and len(got - sampled) < 0.02 * len(got) + 8
    walk = df.where("id = 32").select(geo.hex_walk(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 1.3).alias("w")).first()["w"]
    assert [c["q"] for c in walk] == sorted(c["q"] for c in walk) and all(abs(a["q"] - b["q"]) + abs(a["r"] - b["r"]) + abs(a["q"] + a["r"] - b["q"] - b["r"]) == 2 for a, b in pairwise(walk))
    cells = spark.createDataFrame([(0, 0, 5), (1, 0, None), (99, 99, 1)], "q long, r long, n long")
    sums = {r["id"]: (r["n_cells"], r["total"]) for r in spatial.crossed_sums(df, cells, "n", 1.3).collect()}
    assert sums[30] == (1, 0) and sums[33] == (0, 0) and sums[31][1] == 5
    assert all(sums[i][0] == sum(c[0] == i for c in got) for i in sums)


def thinned(rows, radius, order):
    kept = []
    for r in sorted(rows, key=order):
        if r[1] is None or not any(k[3] == r[3] and k[1] is not None and math.hypot(k[1] - r[1], k[2] - r[2]) <= radius for k in kept):
            kept.append(r)
    return sorted(r[0] for r in kept)


KINDS = "id long, x double, y double, kind string, score double"


@pytest.mark.parametrize("spread", [3.0, 30.0, 300.0])
def test_thinning_against_brute_force(spark, spread):
    rng = random.Random(int(spread))
    rows = [(i, rng.choice([0.0, rng.uniform(0, spread)]), rng.uniform(0, spread), rng.choice(["a", "b", None]), float(rng.randrange(5))) for i in range(250)] + [(990, None, 1.0, "a", 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, KINDS)
    out = safety.thin_points(df, 10.0, ["kind"])
    assert out.columns == df.columns and sorted(r["id"] for r in out.collect()) == thinned(rows, 10.0, lambda r: r[0])
    best = safety.thin_points(df, 10.0, ["kind"], F.struct(-F.col("score"), F.col("id")))
    assert sorted(r["id"] for r in best.collect()) == thinned(rows, 10.0, lambda r: (-r[4], r[0]))


def test_a_crowd_makes_no_pairs_and_no_group(spark):
    rows = [(i, (i * 7919 % 1000) / 100, (i * 104729 % 1000) / 100, "a", 0.0) for i in range(4000)]
    df = spark.createDataFrame(rows, KINDS)
    out = safety.thin_points(df, 1.0, ["kind"])
    assert sorted(r["id"] for r in out.collect()) == thinned(rows, 1.0, lambda r: r[0])
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_suggestions_are_ranked_and_thinned_over_kinds(spark):
    rows = [
        ("u", 1, 0.5, 0.0, 0.0, "routine"), ("u", 2, 0.9, 100.0, 0.0, "saved"), ("u", 3, 0.9, 240.0, 0.0, "recent"), ("u", 4, 0.4, 600.0, 0.0, "recent"),
        ("u", 5, None, 900.0, 0.0, "recent"), ("u", 6, 5.0, 5000.0, 10.0, "saved"), ("v", 7, 0.1, 0.0, 0.0, "saved"), ("v", 8, 0.2, None, None, "saved"),
    ]
    df = spark.createDataFrame(rows, "user string, id long, score double, x double, y double, kind string")
    got = {(r["user"], r["rank"]): r["id"] for r in trips.ranked_suggestions(df, 3, F.lit(5000.0), F.lit(0.0)).collect()}
    assert got == {("u", 1): 2, ("u", 2): 4, ("u", 3): 5, ("v", 1): 8, ("v", 2): 7}
    assert trips.ranked_suggestions(df, 9).where("user = 'u'").count() == 4 and trips.ranked_suggestions(df.limit(0), 3).count() == 0
