"""Crowded and far points, statistics over resampled blocks, the temporal design, simplified rings, and filters that a service takes over."""

import http.server
import json
import math
import random
import sqlite3
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import evaluate, models, spatial
from meridian.sources import readers, sinks
from meridian.streaming import state

POINT = "id long, x double, y double, w double"


def crowd(seed, n=600):
    """Most points at or near one place, the others anywhere."""
    rng = random.Random(seed)
    rows = [(i, 5.0, 5.0, 1.0) for i in range(n // 3)]
    rows += [(i, rng.gauss(0, 2), rng.gauss(0, 2), rng.choice([None, 1.0, 2.5])) for i in range(n // 3, n - 60)]
    rows += [(i, rng.uniform(-99, 99), rng.uniform(-99, 99), 4.0) for i in range(n - 60, n - 2)]
    return rows + [(n - 2, None, 1.0, 9.0), (n - 1, float("nan"), 1.0, 9.0)]


@pytest.mark.parametrize("most, radius", [(1, 3.0), (50, 3.0), (4096, 3.0), (10, 0.4), (10, 150.0)])
def test_sums_within_a_radius(spark, monkeypatch, most, radius):
    monkeypatch.setattr(spatial, "MOST_PAIRS", most)
    rows = crowd(1)
    df = spark.createDataFrame(rows, POINT)
    got = {r["id"]: (r["n"], r["total"]) for r in spatial.near_sums(df, df, radius, "w").collect()}
    for i, x, y, _ in rows:
        near = [w or 0.0 for _, u, v, w in rows if None not in (x, u) and math.hypot(x - u, y - v) <= radius]
        assert got[i] == (len(near), pytest.approx(sum(near)))
    units = df.select("id", "x", "y", F.col("w").alias("count"), (F.col("id") % 7 + 1).cast("double").alias("length"))
    dense = {r["id"]: r["density"] for r in spatial.neighbour_density(units, radius, 2).collect()}
    for i, x, y, _ in rows[::17]:
        other = [(w or 0.0, j % 7 + 1) for j, u, v, w in rows if j != i and None not in (x, u) and math.hypot(x - u, y - v) <= radius]
        assert dense[i] == pytest.approx(sum(c for c, _ in other) / (sum(n for _, n in other) / 100) / 2 if other else 0.0)


def test_points_at_one_place_make_no_pairs(spark, monkeypatch):
    seen, write = [], spatial.Scratch.write
    monkeypatch.setattr(spatial.Scratch, "write", lambda self, df: seen.append(write(self, df)) or seen[-1])
    df = spark.range(5000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(1.0).alias("w"))
    assert {(r["n"], r["total"]) for r in spatial.near_sums(df, df, 3.0, "w").collect()} == {(5000, 5000.0)}
    pairs = [t for t in seen if "whole" in t.columns]
    assert len(pairs) == 1 and pairs[0].count() == 1 and pairs[0].first()["whole"]
    assert spatial.near_sums(df.limit(0), df, 3.0, "w").count() == 0 and spatial.near_sums(df.limit(3), df.limit(0), 3.0, "w").where("n = 0 and mean is null").count() == 3


@pytest.mark.parametrize("far", [0.0, 40.0, 1e5, 1e9])
def test_far_points_find_their_nearest(spark, monkeypatch, far):
    monkeypatch.setattr(spatial, "FEW", 5)
    rng = random.Random(8)
    a = [(i, rng.uniform(-50, 50) + far * (i % 2), rng.uniform(-50, 50) - far * (i % 3)) for i in range(60)]
    b = [(100 + i, rng.choice([0.0, rng.uniform(-20, 20)]), rng.choice([0.0, rng.uniform(-20, 20)])) for i in range(300)]
    rounds, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *x: rounds.append(1) or within(*x))
    got = {r["id"]: (r["near_id"], r["dist"]) for r in spatial.nearest(spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id long, x double, y double"), 0.5).collect()}
    for i, x, y in a:
        dist, j = min((math.hypot(x - u, y - v), j) for j, u, v in b)
        assert got[i] == (j, pytest.approx(dist))
    assert len(rounds) <= spatial.DOUBLINGS


def test_nearest_to_one_place(spark):
    a = spark.createDataFrame([(1, 1e6, 0.0), (2, 0.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 3.0, 4.0), (6, 3.0, 4.0)], "id long, x double, y double")
    assert {r["id"]: (r["near_id"], r["dist"]) for r in spatial.nearest(a, b, 0.01).collect()} == {1: (6, pytest.approx(math.hypot(999_997, 4))), 2: (6, 5.0)}
    assert spatial.nearest(a, b.limit(0), 1.0).count() == 0


# --- statistics over blocks


def block_rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice("abcdefghij"), rng.randrange(8) / 8, rng.random(), rng.random() < 0.3, rng.choice([None, 1.0, 2.0])) for _ in range(n)]


BLOCKS = "block string, score double, size double, hit boolean, v double"


def draws_of(blocks, reps, seed):
    rng = np.random.default_rng(seed)
    return [(r, b, int(t)) for r in range(reps) for b, t in zip(blocks, rng.multinomial(len(blocks), [1 / len(blocks)] * len(blocks))) if t]


def test_means_and_ratios_over_blocks(spark):
    rows, draws = block_rows(1), draws_of("abcdefghij", 40, 2)
    df, table = spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(draws, "rep long, block string, times long")
    times = {(r, b): t for r, b, t in draws}

    def brute(stat):
        v = [stat([(x, times.get((r, x[0]), 0)) for x in rows]) for r in range(40)]
        return (stat([(x, 1) for x in rows]), *np.percentile(v, [2.5, 97.5]))

    mean = evaluate.block_interval(df, {"t": F.col("v"), "n": F.col("v").isNotNull().cast("long")}, F.col("t") / F.col("n"), "block", draws=table).first()
    assert tuple(mean) == pytest.approx(brute(lambda rs: sum(x[4] * t for x, t in rs if x[4]) / sum(t for x, t in rs if x[4])))
    ratio = evaluate.block_interval(df, {"a": F.col("size") * F.col("hit").cast("int"), "b": F.col("size")}, F.col("a") / F.col("b"), "block", draws=table).first()
    assert tuple(ratio) == pytest.approx(brute(lambda rs: sum(x[2] * t for x, t in rs if x[3]) / sum(x[2] * t for x, t in rs)))

    def auc(rs):
        p, n = [(x[1], t) for x, t in rs if x[3]], [(x[1], t) for x, t in rs if not x[3]]
        return sum(a * b * ((s > u) + (s == u) / 2) for s, a in p for u, b in n) / (sum(a for _, a in p) * sum(b for _, b in n))

    assert tuple(evaluate.block_auc(df, "score", F.col("hit"), "block", draws=table).first()) == pytest.approx(brute(auc))
    own = evaluate.block_auc(df, "score", F.col("hit"), "block", reps=60).first()
    assert own["low"] <= own["value"] <= own["high"] and own["high"] - own["low"] < 0.4


def test_times_of_blocks(spark):
    df = spark.range(300).select(F.inline(evaluate.block_times(F.col("id"), 50)))
    times = df.agg(F.sum("times"), F.count("*")).first()
    assert times[0] == pytest.approx(15_000, rel=0.03) and times[1] == pytest.approx(15_000 * (1 - math.exp(-1)), rel=0.03)


def test_too_many_draws_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "MOST_DRAWS", 100)
    df = spark.createDataFrame([(f"b{i}", float(i), 1.0, i, 1) for i in range(11)], "block string, s double, length double, tie int, n int")
    with pytest.raises(ValueError, match="draws"):
        evaluate.resampled_captures(df, ["s"], "n", "length", "block", "tie", reps=10)


# --- the temporal design


def temporal_cells(seed=0, dark=3.0, wet=1.5, years=(2020, 2021)):
    rng, rows = np.random.default_rng(seed), []
    base = {"arterial": 0.02, "collector": 0.01, "local": 0.004}
    for g, rate in base.items():
        for day in ("weekday", "saturday"):
            for hour in range(24):
                for rain in (False, True):
                    for year in years:
                        light, hours = "dark" if hour < 6 or hour > 19 else "day", rng.uniform(200, 900)
                        for ped in (False, True):
                            mu = hours * rate * (0.2 if ped else 1) * (1.4 if year == 2021 else 1) * ((dark if ped else 1.2) if light == "dark" else 1) * (wet if rain else 1)
                            rows.append((g, day, hour, light, rain, year, ped, int(rng.poisson(mu)), hours))
    return rows


CELLS = "road_group string, day_group string, hour int, light string, wet boolean, year int, is_ped boolean, count long, hours double"


@pytest.fixture(scope="module")
def temporal(spark):
    cells = spark.createDataFrame(temporal_cells(), CELLS)
    return cells, models.fit_temporal(cells, "road_group", ["local", "arterial", "collector"], "is_ped", 1e-4)


def test_design_has_interactions_hours_and_years(temporal):
    names = list(temporal[1].design.columns())
    assert len(names) == len(set(names)) == 1 + 2 + 3 + 23 + 2 + 1 + (2 + 4 + 3 + 2 + 1) + 1 + 1
    assert {"hour=0", "flag:hour_bin=0-5", "flag:light=dark", "flag:road_group=arterial", "flag:wet", "year=2021", "flag:year=2021"} <= set(names) and "hour=12" not in names


def test_effects_come_back(temporal):
    e = temporal[1].effects()
    assert e["dark"] == pytest.approx(3.0, rel=0.3) and e["wet"] == pytest.approx(1.5, rel=0.2) and e["flag_x_dark"] > 1.5


def test_parts_and_base_add_up_on_every_row(spark, temporal):
    cells, m = temporal
    one = cells.where("is_ped and year = 2020").drop("year")
    told = m.parts(one)
    total = F.aggregate(F.array("factors.*"), F.col("base"), lambda t, x: t + x)
    assert told.count() == one.count() and told.where(F.abs(total - F.ln("multiplier")) > 1e-9).count() == 0
    assert told.where("factors.light <> 0 and light = 'day' or factors.rain <> 0 and not wet").count() == 0
    mean = told.groupBy("road_group").agg((F.sum(F.col("multiplier") * F.col("hours")) / F.sum("hours")).alias("m")).collect()
    assert [r["m"] for r in mean] == pytest.approx([1.0] * 3)


# --- simplified paths and rings


def away(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    n = d[0] ** 2 + d[1] ** 2
    t = min(1, max(0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0
    return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])


def brute_simple(path, tolerance):
    if len(path) < 3:
        return path
    k = max(range(1, len(path) - 1), key=lambda i: away(path[i], path[0], path[-1]))
    if away(path[k], path[0], path[-1]) <= tolerance:
        return [path[0], path[-1]]
    return brute_simple(path[: k + 1], tolerance)[:-1] + brute_simple(path[k:], tolerance)


def test_paths_are_simplified(spark):
    rng = random.Random(5)
    paths = [[(float(i), rng.gauss(0, 1)) for i in range(rng.randrange(2, 60))] for _ in range(30)] + [[(0.0, 0.0)], [], [(0.0, 0.0), (1.0, 0.0)], [(2.0, 2.0)] * 5]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(99, None)], "id long, path array<struct<x:double,y:double>>")
    got = {r["id"]: r["p"] and [tuple(p) for p in r["p"]] for r in df.select("id", geo.simplify(F.col("path"), 0.8).alias("p")).collect()}
    assert got[99] is None
    for i, p in enumerate(paths[:33]):
        assert (got[i] or []) == brute_simple(p, 0.8)


def test_rings_stay_rings(spark):
    turn = [2 * math.pi * i / 200 for i in range(200)]
    circle = [(10 * math.cos(t), 10 * math.sin(t)) for t in turn]
    comb = [(0.0, 0.0)] + [(x / 2, 5.0 if x % 2 else 0.2) for x in range(1, 40)] + [(20.0, 0.0)]
    rings = [[*circle, circle[0]], [*comb, comb[0]], [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1), (0.0, 0.0)]]
    df = spark.createDataFrame([(rings,)], "rings array<array<struct<x:double,y:double>>>")
    got = df.select(geo.simplify_rings(F.col("rings"), 0.3).alias("r")).first()["r"]
    for before, after in zip(rings, got):
        after = [tuple(p) for p in after]
        assert after[0] == after[-1] and len(after) >= 4 and set(after) <= set(before) and not geo._crosses(np.array(after))
    assert 10 < len(got[0]) < 40
    assert all(min(away(p, tuple(a), tuple(b)) for a, b in zip(got[0], got[0][1:])) <= 0.3 for p in circle)
    bow = np.array([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], float)
    assert geo._crosses(bow)
    feature = json.loads(df.select(sinks.outline(F.col("rings"), F.struct(F.lit("x").alias("name")), 0.3)).first()[0])
    assert feature["geometry"]["type"] == "Polygon" and len(feature["geometry"]["coordinates"]) == 3 and feature["properties"] == {"name": "x"}


# --- filters that a service takes over


@pytest.fixture
def service():
    """A feature service over a table, that evaluates `where` and remembers what it was asked."""
    asked, db, lock = [], sqlite3.connect(":memory:", check_same_thread=False), threading.Lock()
    db.execute("CREATE TABLE t (oid INTEGER, kind TEXT COLLATE NOCASE, n INTEGER, v REAL)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, ["a", "A", "b's", None][i % 4], i % 10 if i % 7 else None, i / 4) for i in range(100)])

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
            if not url.path.endswith("query"):
                out = {"objectIdField": "oid"}
            else:
                asked.append(q)
                with lock:
                    rows = db.execute(f"SELECT oid, kind, n, v FROM t WHERE {q['where']} ORDER BY oid").fetchall()
                start = int(q.get("resultOffset", 0))
                fields = ["oid", "kind", "n", "v"] if q["outFields"] == "*" else q["outFields"].split(",")
                page = [dict(zip(("oid", "kind", "n", "v"), r)) for r in rows[start : start + int(q.get("resultRecordCount", 1000))]]
                out = {"count": len(rows)} if q.get("returnCountOnly") else {"features": [{"attributes": {f: r[f] for f in fields}} for r in page]}
            body = json.dumps(out).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/layer", asked
    server.shutdown()


@pytest.mark.parametrize(
    "condition, where",
    [
        ("n > 3", "n > 3"),
        ("n in (1, 2) and v < 20.5", "v < 20.5"),
        ("kind = 'a'", "kind = 'a'"),
        ("kind = \"b's\" and n is not null", "kind = 'b''s'"),
        ("not (n = 3)", "NOT (n = 3)"),
        ("not (kind = 'a')", None),
        ("kind is null or n = 1", None),
        ("n is null", "n IS NULL"),
        ("kind > 'a'", None),
        ("n <=> 4", "n = 4"),
    ],
)
def test_filters_reach_the_service(spark, service, condition, where):
    url, asked = service
    df = readers.feature_server(spark, url, "oid long, kind string, n int, v double", pageSize=30)
    rows = [(i, ["a", "A", "b's", None][i % 4], i % 10 if i % 7 else None, i / 4) for i in range(100)]
    expected = sorted(r[0] for r in spark.createDataFrame(rows, "oid long, kind string, n int, v double").where(condition).collect())
    assert sorted(r["oid"] for r in df.where(condition).select("oid").collect()) == expected
    said = asked[-1]["where"]
    assert asked[-1]["outFields"] == "oid,kind,n,v" and (where in said if where else "kind >" not in said and "NOT (kind" not in said and "OR" not in said)


def test_whole_features_as_before(spark, service):
    url, asked = service
    got = readers.feature_server(spark, url, pageSize=40).where("value like '%\"oid\": 7,%'").collect()
    assert len(got) == 1 and json.loads(got[0]["value"])["attributes"]["oid"] == 7 and asked[-1]["where"] == "1=1"


# --- hot keys


def test_one_key_may_hold_all_rows(spark):
    events = spark.range(2000).select(F.lit("a").alias("k"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    nulls = events.limit(3).withColumn("k", F.lit(None).cast("string"))
    both = events.unionByName(nulls)
    capped = state.daily_cap(both, "k", 2)
    assert capped.columns == both.columns and sorted(((r["k"], r["event_id"]) for r in capped.collect()), key=str) == sorted([("a", 0), ("a", 1), ("a", 1440), ("a", 1441), (None, 0), (None, 1)], key=str)
    got = {r["k"]: r["confirmations"] for r in state.upsert_reports(both, ["k"], F.expr("interval 2 minutes")).collect()}
    assert got == {"a": 2000, None: 3}
    for out in (capped, state.upsert_reports(both, ["k"], F.expr("interval 2 minutes"))):
        assert "hashpartitioning(k#" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_registered_split_adds_up(spark):
    from conftest import DATA
    from meridian.plans import catalog

    out = catalog.queries()["temporal_split"](spark, DATA)
    assert out.where("abs(time_of_day + day_of_week + darkness + rain + base - ln(multiplier)) > 1e-9 or multiplier is null").count() == 0
    assert out.count() > 500 and out.select("time_of_day").distinct().count() > 20


# --- operators without a query of their own


def test_inherited_segments_and_facilities(spark):
    line = "id long, x1 double, y1 double, x2 double, y2 double"
    roads = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (2, 0.0, 0.0, 0.0, 100.0)], line)
    rows = [(10, 0.0, 10.0, 100.0, 10.0, "road"), (11, 0.0, 20.0, 100.0, 20.0, "road"), (12, 0.0, 20.0, 100.0, 20.0, "path"), (13, 10.0, 0.0, 10.0, 20.0, "crossing"), (14, 50.0, -5.0, 50.0, 5.0, "road"), (15, 50.0, -5.0, 50.0, 5.0, "crossing")]
    edges = spark.createDataFrame(rows, line + ", kind string")
    assert {r["id"]: r["seg"] for r in spatial.inherit_segments(edges, roads).collect()} == {10: 1, 11: -1, 12: 1, 13: 1, 14: -1, 15: 1}
    first = roads.withColumn("facility", F.when(F.col("id") == 1, 2).otherwise(0))
    second = spark.createDataFrame([(7, 0.0, 5.0, 100.0, 5.0, 3), (8, 0.0, 0.0, 0.0, 90.0, 1)], line + ", facility int")
    got = {r["id"]: r["facility"] for r in spatial.strongest_facility(roads.unionByName(edges.where("id = 11").drop("kind")), [first, second]).collect()}
    assert got == {1: 3, 2: 1, 11: 3}


def test_identity_gap(spark):
    from meridian.operators import products

    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (None, 1.0)], "a double, b double")
    assert products.identity_gap(df, F.col("a"), F.col("b")).first()["gap"] == 0.5


def test_bands_of_each_part_of_the_day(spark):
    from meridian.operators import safety

    rng = random.Random(4)
    rows = [(i, p, rng.choice([0, 1, 2, 3, 30 if i % 9 == 0 else 4]), None if i % 5 == 0 else rng.uniform(0.5, 3)) for i in range(40) for p in ("night", "morning", "evening")] + [(99, None, 5, 1.0)]
    df = spark.createDataFrame(rows, "area long, day_part string, n long, rate double")
    got = {(r["area"], r["day_part"]): (r["exposure"], r["band"]) for r in safety.incident_bands(df, "n", "rate").collect()}
    assert got[99, None] == (None, "typical")
    for part, hours in (("night", 8), ("morning", 6), ("evening", 4)):
        mine = [(a, n, r) for a, p, n, r in rows if p == part]
        median = float(np.median([r for _, _, r in mine if r is not None]))
        exposure = {a: (median if r is None else r) * hours for a, _, r in mine}
        y, e = np.array([n for _, n, _ in mine], float), np.array([exposure[a] for a, _, _ in mine])
        m = y.sum() / e.sum()
        variance = (((y - e * m) ** 2).sum() - y.sum()) / (e**2).sum()
        alpha = m * m / variance
        for a, n, _ in mine:
            shape, rate = n + alpha, exposure[a] + alpha / m
            x = (np.arange(200_000) + 0.5) / 200_000 * m  # the chance of a rate under the mean, by the midpoint rule
            below = float(np.exp(shape * math.log(rate) + (shape - 1) * np.log(x) - rate * x - math.lgamma(shape)).sum() * m / 200_000)
            band = "higher" if n > 0 and 1 - below >= 0.9 else "lower" if below >= 0.9 else "typical"
            assert got[a, part][0] == pytest.approx(exposure[a]) and (got[a, part][1] == band or abs(below - 0.9) < 1e-3 or abs(below - 0.1) < 1e-3)
    assert len({b for _, b in got.values()}) > 1
    assert safety.incident_bands(df.limit(0), "n", "rate").count() == 0


def test_safety_of_areas(spark):
    from meridian.operators import safety

    areas = spark.createDataFrame([(1,), (2,)], "area long")
    banded = spark.createDataFrame([(1, "night", 3, "higher"), (1, "morning", 1, "typical"), (7, "night", 9, "higher")], "area long, day_part string, count long, band string")
    activity = spark.createDataFrame([(1, "night", "quiet"), (2, "evening", "busy")], "area long, day_part string, activity string")
    lit = spark.createDataFrame([(1, 0.12345)], "area long, share double")
    places = spark.createDataFrame([(2, 4)], "area long, n long")
    got = {r["area"]: r for r in safety.area_safety(areas, "area", banded, activity, lit, places).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["incidents_night"], got[1]["band_night"], got[1]["activity_night"], got[1]["incidents_evening"], got[1]["lit_share"], got[1]["places"]) == (3, "higher", "quiet", 0, 0.123, 0)
    assert (got[2]["incidents_night"], got[2]["band_morning"], got[2]["activity_evening"], got[2]["activity_night"], got[2]["lit_share"], got[2]["places"]) == (0, "typical", "busy", "unknown", None, 4)
