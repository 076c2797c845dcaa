"""Small tables on which queries differed from their SQL, or took steps that grow faster than the input."""

import datetime as dt

import pytest

from conftest import rows_of
from meridian.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def against_sql(spark, tmp_path, name, **tables):
    """Rows of a query over small tables, after they were found equal to those of its SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 1")
    for t, (rows, schema) in tables.items():
        path = f"{tmp_path}/{t}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    got, expected = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(SQL[name]).df()
    assert rows_of(got) == rows_of(expected)
    return got


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
T0 = dt.datetime(2024, 1, 1, 6)


def test_hotspot_scores_round_halves_to_even(spark, tmp_path):
    rows = [(i, T0, i, "view", v) for i, v in enumerate([100.5, 99.5, 98.5, 80.5, 3.0])]
    got = against_sql(spark, tmp_path, "hotspot_top5pct", events=(rows, EVENTS))
    assert list(got["s"]) == [100, 100]


def test_nothing_is_shared_without_a_first_list(spark, tmp_path):
    rows = [(1, T0, 1, "view", 200.0), (2, T0, 2, "view", 5.0), (3, T0, 3, "view", 200.0), (4, T0, 3, "view", 5.0), (5, T0, 4, "view", 200.0), (6, T0, 4, "click", 5.0)]
    got = against_sql(spark, tmp_path, "set_shared", events=(rows, EVENTS)).set_index("user_id")["names"]
    assert got[3] == "view" and got[1] == got[4] == "" and got[[2]].isna().all()


def test_frames_add_up_in_order_of_events(spark, tmp_path):
    rows = [(i, T0, 1, "view", v) for i, v in enumerate([6.62, 203.84, 68.88, 25.66])]
    for part, given in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(given, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/{part}/events.parquet")
        assert [r["scores"] for r in QUERIES["frame_pack"](spark, f"{tmp_path}/{part}").collect()] == ["31"]  # 305.00000000000006 one way, 305.0 the other


def test_day_part_rates_round_as_the_sql(spark, tmp_path):
    rows = [(i, f"s{i}", 1, i / 100) for i in range(340_000, 341_000)]
    against_sql(spark, tmp_path, "period_day_part_rates", supplier=(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"))


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_copies_of_a_small_table_are_not_broadcast(spark):
    from meridian.operators import routing, spatial

    p = spark.range(50).selectExpr("id", "cast(id as double) as x", "0D as y", "id as t")
    lines = p.selectExpr("id", "x as x1", "y as y1", "x + 5 as x2", "y as y2")
    assert broadcasts(spatial.cell_pairs(p, p, 2.0, ("t", 3.0))) == 0
    assert broadcasts(spatial.points_near_lines(p, lines, 2.0)) == 0
    assert spatial.within(p, p, 1.0).count() == 148


def test_densities_by_hour_are_not_broadcast(spark):
    from meridian.operators import routing

    paths = spark.range(3).selectExpr("id as query", "0D as weight", "0 as pos", "id as eid")
    edges = spark.range(3).selectExpr("id as eid", "60D as time")
    departs = spark.range(3).selectExpr("id as query", "timestamp'2024-01-01 05:00:00' as depart")
    hours = spark.range(3).selectExpr("id as eid", "explode(sequence(0, 23)) as hour").selectExpr("*", "eid + hour / 100 as log_density")
    timed = routing.timed_densities(paths, edges, departs, hours)
    joins = timed._jdf.queryExecution().optimizedPlan().toString()
    assert joins.index("rightHint=(strategy=merge)") < joins.index("Project", joins.index("rightHint"))
    assert sorted(r["log_density"] for r in timed.collect()) == [0.05, 1.05, 2.05]


def test_rounds_gather_no_table_at_the_driver(spark, monkeypatch):
    from meridian.operators import graph, safety
    from meridian.plans.scratch import Scratch

    seen, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (seen.append(broadcasts(df)), write(self, df))[1])
    out = graph.connected_components(spark.range(1, 40).selectExpr("id as src", "id + 1 as dst"))
    assert {r["component"] for r in out.collect()} == {1} and broadcasts(out) == sum(seen) == 0
    seen.clear()
    joined = []
    hint = type(out).hint
    monkeypatch.setattr(type(out), "hint", lambda self, name, *a: (joined.append(name), hint(self, name, *a))[1])
    kept = safety.thin_points(spark.range(20).selectExpr("id", "cast(id as double) as x", "0D as y", "1 as g"), 1.5, ["g"])
    assert sorted(r["id"] for r in kept.collect()) == list(range(0, 20, 2)) and "merge" in joined


def test_positions_bring_few_of_many_alerts(spark, monkeypatch):
    """A thousand alerts at one place: a position brings what its walk can have spoken before and little more."""
    from meridian.streaming import live

    seen, walked = [], live.walked
    monkeypatch.setattr(live, "walked", lambda rows, *a: (seen.append(rows), walked(rows, *a))[1])
    rows = [(i, T0 + dt.timedelta(seconds=20 * i), "a", 0, 100.0 + i % 3) for i in range(30)]
    positions = spark.createDataFrame(rows, "event_id long, ts timestamp, k string, path int, along double")
    alerts = spark.createDataFrame([(0, a, 100.0 + a % 7, 150.0 if a > 3 else 101.0) for a in range(1, 1001)], "path int, alert long, start double, end double")
    got = {tuple(r) for r in live.due_alerts(positions, alerts, "k").collect()}
    spoken, last, want = set(), None, set()
    for i, t, _, _, along in rows:
        if last is None or (t - last).total_seconds() >= 45:
            a = next(a for a in range(1, 1001) if a not in spoken and along < (150.0 if a > 3 else 101.0))
            spoken.add(a)
            last = t
            want.add((i, a))
    assert got == want
    assert max(len(r["alerts"]) for r in seen[0].collect()) <= 30 * 20 // 45 + 2


def test_links_of_cells_tell_the_components_of_all_pairs(spark, monkeypatch):
    import math
    import random

    from meridian.operators import graph, spatial

    monkeypatch.setattr(spatial, "MOST_PAIRS", 4)  # so that cells are halved
    rng = random.Random(5)
    rows = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(60)] + [(i, 5 + rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(60, 200)] + [(200, 500.0, 500.0), (201, None, 1.0)]
    rows += [(202, -500.0, 0.0), (203, -490.0, 0.0), (204, -480.0, 0.0)]
    placed = [r for r in rows if r[1] is not None]
    least = {i: i for i, _, _ in placed}
    near = [(a[0], b[0]) for a in placed for b in placed if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 10]
    while True:
        moved = [(a, b) for a, b in near if least[a] != least[b]]
        if not moved:
            break
        for a, b in moved:
            least[a] = least[b] = min(least[a], least[b])
    points = spark.createDataFrame(rows, "id long, x double, y double")
    links = spatial.near_links(points, 10.0)
    got = {r["node"]: r["component"] for r in graph.connected_components(links).collect()}
    linked = {i for pair in near for i in pair}
    assert got == {i: c for i, c in least.items() if i in linked}
    assert links.count() < len(near) / 8


def test_degrees_make_no_edges(spark, tmp_path, monkeypatch):
    from meridian.plans import q_space

    monkeypatch.setattr(q_space, "network", lambda *a: pytest.fail("edges were made"))
    rows = [(i, [i * 0.02, 0.0], i % 10) for i in range(6)] + [(9, [5.0, 5.0], 1)]
    against_sql(spark, tmp_path, "node_degree", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    got = QUERIES["component_share"](spark, str(tmp_path)).collect()
    assert [r["share"] for r in got] == [round(6 / 7, 6)]


def test_distances_of_a_metric_network_take_one_round(spark, monkeypatch):
    import math
    import random

    from meridian.operators import routing
    from meridian.plans.scratch import Scratch

    rng, written, write = random.Random(2), [], Scratch.write
    at = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(60)]
    far = lambda a, b: math.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])
    edges = routing.both_ways(spark.createDataFrame([(a * 100 + b, a, b, far(a, b)) for a in range(60) for b in range(a + 1, 60) if far(a, b) <= 50], "eid long, u long, v long, length double"))
    sources = spark.range(60).selectExpr("id as query", "id as node")
    any_way = {(r["query"], r["node"]): r["dist"] for r in routing.distances(edges, sources, "length", 40.0).collect()}
    monkeypatch.setattr(Scratch, "write", lambda self, df: (written.append(1), write(self, df))[1])
    got = {(r["query"], r["node"]): r["dist"] for r in routing.distances(edges, sources, "length", 40.0, metric=True).collect()}
    assert got.keys() == any_way.keys() and len(written) == 1
    assert all(abs(got[k] - any_way[k]) < 1e-9 for k in got)


def test_trips_bring_few_edges_of_their_box(spark, monkeypatch):
    import math
    import random

    from meridian.operators import routing

    rng, seen, reachable = random.Random(8), [], routing.reachable_edges
    at = {i: (rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(250)} | {250: (900.0, 900.0), 251: (5.0, -200.0), 252: (5.0, -240.0)}
    far = lambda a, b: math.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])
    rows = [(a * 1000 + b, a, b, far(a, b), (a * 7 + b) % 5 / 2, 1.0 + (a + b) % 3) for a in at for b in at if a < b and far(a, b) <= 50]
    both = routing.both_ways(spark.createDataFrame(rows, "eid long, u long, v long, time double, risk double, penalty double"))
    nodes = spark.createDataFrame([(i, x, y) for i, (x, y) in at.items()], "id long, x double, y double")
    trips = spark.createDataFrame([(q, a, b, *at[a], *at[b]) for q, (a, b) in enumerate([(0, 1), (2, 3), (4, 5), (6, 250), (251, 7)])], "query long, origin long, target long, x1 double, y1 double, x2 double, y2 double")
    trips = routing.trip_guards(trips).where("status = 'ok'")
    monkeypatch.setattr(routing, "reachable_edges", lambda *a: (seen.append(reachable(*a)), seen[-1])[1])
    area = routing.search_edges(trips, nodes, both)
    whole = routing.candidate_paths(area, "time", "risk", 1.0, [0.5, 4.0], penalty="penalty")
    got = routing.plan_paths(trips, nodes, both, "time", "risk", 1.0, [0.5, 4.0], penalty="penalty")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in whole.collect()} and got.select("query").distinct().count() >= 2
    assert sum(s.count() for s in seen) < 3 * area.count() / 2


@pytest.mark.parametrize("angle", [None, 30.0])
def test_nearest_lines_without_all_pairs(spark, monkeypatch, angle):
    import math
    import random

    import numpy as np
    from meridian.operators import spatial

    monkeypatch.setattr(spatial, "AT_ONCE", 500)  # so that lines are sorted by direction
    monkeypatch.setattr(spatial, "MOST_IN_TILE", 300)  # so that tiles are dealt to several groups
    rng = random.Random(4)
    at = lambda: (rng.gauss(0, 12), rng.gauss(0, 12))
    lines = [(i, *at(), *at()) for i in range(900)] + [(900, 1.0, 1.0, 1.0, 1.0), (901, 60.0, 0.0, 90.0, 0.0), (902, 60.0, 0.0, 90.0, 0.0), (903, None, 0.0, 1.0, 1.0)]
    points = [(i, *at(), *at()) for i in range(300)] + [(300, 75.0, 19.0, 1.0, 0.1), (301, 75.0, 19.0, 0.0, 1.0), (302, 95.0, 0.0, -1.0, 0.0), (303, 300.0, 0.0, 1.0, 1.0), (304, None, 0.0, 1.0, 1.0)]
    want = {}
    for i, x, y, dx, dy in points[:-1]:
        for k, x1, y1, x2, y2 in lines[:-1]:
            square = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = 0.0 if square == 0 else max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / square))
            turn = abs(math.degrees(math.atan2(dy, dx) - math.atan2(y2 - y1, x2 - x1))) % 180
            dist = math.hypot(x - (x1 + t * (x2 - x1)), y - (y1 + t * (y2 - y1)))
            if dist <= 20 and (angle is None or min(turn, 180 - turn) <= angle):
                want[i] = min(want.get(i, (math.inf, 0)), (dist, k))
    a = spark.createDataFrame(points, "id long, x double, y double, dx double, dy double")
    b = spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"]: (r["dist"], r["line"]) for r in spatial.nearest_lines(a, b, 20.0, angle).collect()}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-9 for i in want)
    ends, made, spread = np.array([r[1:] for r in lines[:900]]), [], spatial._spread
    monkeypatch.setattr(spatial, "_spread", lambda *r: (made.append(spread(*r)), made[-1])[1])
    some = np.array([r[1:] for r in points[:300]])
    spatial.nearest_of_tile(some[:, :2], np.arctan2(some[:, 3], some[:, 2]), ends, 20.0, angle)
    assert sum(len(i) for i, _ in made) < 300 * 900 / 3


EDGE_QUERIES = ("crossed_cells", "near_any_flag", "corridor_counts")
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", EDGE_QUERIES)
def test_edges_get_their_results_where_they_are_made(spark, tmp_path, monkeypatch, name):
    import random

    from meridian.operators import edges, spatial

    def none(*args):
        raise AssertionError("edges as rows that are joined")

    monkeypatch.setattr(spatial, "within", none)
    monkeypatch.setattr(edges, "BLOCK", 60)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.05), rng.gauss(0, 0.05), 0.0], 7 if rng.random() < 0.03 else i % 5) for i in range(400)]
    rows += [(i, [0.2, 0.2], i % 9) for i in range(400, 420)] + [(420, None, 7), (421, [None, 0.1], 7), (422, [0.9, 0.9], 7), (423, [0.93, 0.9], 1)]
    got = against_sql(spark, tmp_path, name, embeddings=(rows, VECTORS))
    assert len(got) > 10_000


@pytest.mark.parametrize("name", EDGE_QUERIES)
def test_edges_that_share_an_id_are_one(spark, tmp_path, name):
    at = [(1, 0.0, 0), (1_000_003, 0.02, 1), (2, 0.5, 0), (3, 0.53, 7)]  # 1 and 1,000,003 make the same number as 2 and 3
    got = against_sql(spark, tmp_path, name, embeddings=([(i, [x, x / 2], w) for i, x, w in at], VECTORS))
    assert list(got["id"]) == [2_000_003]


def test_copies_of_points_and_polygons_are_tested_once(spark, tmp_path, monkeypatch):
    from meridian.operators import cover

    seen, covered = [], cover.cover
    monkeypatch.setattr(cover, "cover", lambda polygons, size: (seen.append(polygons.count()), covered(polygons, size))[1])
    monkeypatch.setattr(cover, "MOST_COPIES", 2)
    suppliers = [(k + 560 * c, f"s{k}", 1, 37.5 + 11 * k) for k in range(8) for c in range(3)]  # a star depends on the key modulo 560
    events = [(i + 1000 * c, T0, 1, "view", i * 0.3) for i in range(300) for c in range(4)]
    got = against_sql(spark, tmp_path, "polygon_join", supplier=(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), events=(events, EVENTS))
    assert seen == [8] and len(got) % 12 == 0 and len(got) > 100


def test_boosting_passes_over_bins_not_rows(spark, monkeypatch):
    from meridian.operators import models

    rows = [(float(i % 6), float(i % 4), float(i % 3 + i % 6 // 4), 1.0 + i % 2, i % 3) for i in range(600)]
    df, names = spark.createDataFrame(rows, "a double, b double, y double, e double, fold int"), ["a", "b"]
    boosting = models._Boosting(df, names, "y", "e", [], models.Growth(least=5), "fold")
    assert boosting.held.count() == len({(r[0], r[1], r[4]) for r in rows})
    got = {}
    for again in (2, 99):
        monkeypatch.setattr(models, "AGAIN", again)
        got[again] = models.boosting_rounds(df, names, "y", "e", "fold", most=5, least=5)[:2]
    assert got[2][0] == got[99][0] and all(abs(a - b) < 1e-9 for a, b in zip(got[2][1], got[99][1]))
