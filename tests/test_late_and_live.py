"""Streams with late rows, live sessions and stores against their batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meridian.operators import ingest
from meridian.sources.store import Store, refresh, upsert, upsert_sink
from meridian.streaming import late, live, state

T0 = datetime(2024, 1, 1)
NEVER = timedelta(days=400)


@pytest.fixture(scope="module")
def rocks(spark):
    yield late.stateful(spark)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream_of(spark, path, batches):
    """A stream that gives one of the batches at a time."""
    for i, df in enumerate(batches):
        df.coalesce(1).write.parquet(f"{path}/b{i:03d}")
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(path))


def run(stream, tmp_path, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


EVENTS = "id long, x double, y double, ts timestamp, collision_id string"


def crash_rows(seed, n=160):
    """Points in a few places, some close and some just not, in time and in space; ordered by time."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = T0 + timedelta(seconds=rng.choice([0, 1, 1799, 1800, 1801, 3600]) + 900 * rng.randrange(60))
        x, y = rng.choice([-20.0, 0.0, 5.0, 19.9, 20.0, 20.1, 40.0]) + 200 * rng.randrange(3), rng.choice([-0.1, 0.0, 10.0])
        rows.append((i, None if i % 29 == 3 else x, y, t, f"c{i % 7}" if i % 23 == 1 else None))
    rng.shuffle(rows)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    return sorted(rows, key=lambda r: r[3])


def shuffled_within(rows, tolerance, seed):
    """The rows in another order, none later than `tolerance` after a row that is newer."""
    rng = random.Random(seed)
    return [r for _, r in sorted((r[3] + tolerance * rng.random(), r) for r in rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_late_duplicates_equal_the_batch(rocks, tmp_path, seed):
    rows = shuffled_within(crash_rows(seed), timedelta(minutes=50), seed)
    batches = [rocks.createDataFrame(rows[i : i + 40], EVENTS) for i in range(0, len(rows), 40)]
    stream = stream_of(rocks, tmp_path / "in", batches).withWatermark("ts", "1 hour")
    links = late.stream_links(stream, 20.0, 1800)
    store = Store(rocks, str(tmp_path / "clusters"), late.CLUSTERS)
    q = links.writeStream.foreachBatch(late.link_sink(store, 4)).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    events = rocks.createDataFrame(rows, EVENTS)
    expected = ingest.cluster_events(events, ingest.duplicate_links(events, 20.0, 1800))
    got = {r["id"]: r["cluster"] for r in store.read().collect()}
    assert {r["id"]: got.get(r["id"], r["id"]) for r in events.collect()} == {r["id"]: r["cluster"] for r in expected.collect()}
    assert store.read().count() == len(got) and len(set(got.values())) > 3


def test_cells_behind_the_watermark_are_dropped(rocks, tmp_path):
    rows = [(i, 0.0, 0.0, T0 + timedelta(hours=3 * i), None) for i in range(8)]
    batches = [rocks.createDataFrame([r], EVENTS) for r in rows]
    links = late.stream_links(stream_of(rocks, tmp_path / "in", batches).withWatermark("ts", "1 hour"), 20.0, 1800)
    q = links.writeStream.outputMode("append").format("memory").queryName("dropped").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert rocks.table("dropped").count() == 0
        kept = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
        assert max(k["numRowsTotal"] for k in kept) <= 18 and sum(k["customMetrics"]["numDeletedTimers"] for k in kept) == 7 * 9  # nine cells hold a point
    finally:
        q.stop()


def test_links_come_in_any_order(rocks, tmp_path):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    links = [(min(p), max(p)) for p in links if p[0] != p[1]]
    store = Store(rocks, str(tmp_path), late.CLUSTERS)
    for n in range(0, len(links), 9):
        df = rocks.createDataFrame(links[n : n + 9], "src long, dst long")
        assert late.add_links(store, df, n, 4)
        assert not late.add_links(store, df, n, 4)
    label = {i: i for p in links for i in p}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["cluster"] for r in store.read().collect()} == label


def test_stream_as_of_equals_batch(rocks, tmp_path):
    rng = random.Random(6)
    at = lambda: T0 + timedelta(seconds=rng.randrange(2000))
    facts = [(rng.choice("ab"), at(), float(i % 5)) for i in range(60)]
    asks = [(i, rng.choice("abc"), at()) for i in range(80)]
    fs, qs = "k string, ts timestamp, v double", "ask long, k string, ts timestamp"
    key = lambda r: r[-1] if isinstance(r[-1], datetime) else r[1]
    late_by = lambda rows: [r for _, r in sorted((key(r) + timedelta(seconds=50 * rng.random()), r) for r in rows)]
    end = T0 + NEVER
    lf, lq = late_by(facts), late_by(asks)
    fb = [rocks.createDataFrame(lf[i : i + 15], fs) for i in range(0, 60, 15)] + [rocks.createDataFrame([("z", end, 0.0)], fs), rocks.createDataFrame([("z", end + NEVER, 0.0)], fs)]
    qb = [rocks.createDataFrame(lq[i : i + 20], qs) for i in range(0, 80, 20)] + [rocks.createDataFrame([(-1, "z", end)], qs), rocks.createDataFrame([(-2, "z", end + NEVER)], qs)]
    out = late.stream_as_of(stream_of(rocks, tmp_path / "q", qb), stream_of(rocks, tmp_path / "f", fb), ["k"], "v", 100, "60 seconds")
    got = [(r["ask"], r["v"]) for r in run(out, tmp_path, "asof").collect() if r["ask"] >= 0]
    expected = state.as_of(rocks.createDataFrame(asks, qs), rocks.createDataFrame(facts, fs), ["k"], "v", 100)
    assert sorted(got, key=str) == sorted(((r["ask"], r["v"]) for r in expected.collect()), key=str)


# --- stores


def files(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet") if "versions" not in str(p)}


def test_refresh_equals_a_rebuild_and_leaves_other_parts_alone(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"2024-01-{rng.randrange(1, 9):02d}", rng.choice("abc"), rng.randrange(10)) for _ in range(300)]
    late_rows = [("2024-01-03", "a", 5), ("2024-01-03", "z", 1)]
    store = Store(spark, str(tmp_path / "s"), "day string, k string, n long")
    put = lambda part, batch: refresh(store, spark.createDataFrame(part, "day string, k string, n long"), batch, ["day", "k"], ["n"], F.col("day"))
    for i in range(3):
        assert put(rows[i::3], i)
    before = files(tmp_path / "s")
    assert put(late_rows, 3)
    assert not put(late_rows, 3) and not put(rows, 1)
    after = files(tmp_path / "s")
    assert before.items() <= after.items() and all("batch=3/part=2024-01-03" in str(p) for p in after.keys() - before.keys())
    expected = {}
    for d, k, n in rows + late_rows:
        expected[d, k] = expected.get((d, k), 0) + n
    assert {(r["day"], r["k"]): r["n"] for r in store.read().collect()} == expected
    folders = store.current()[2]
    assert all("batch=2" in f or "batch=3" in f or "batch=1" in f or "batch=0" in f for f in folders.values()) and "batch=3" in folders["2024-01-03"]


def test_upserts_check_stamps_and_replays_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "k string, v long, stamp long")
    change = "k string, v long, stamp long, expected long"
    put = lambda rows, batch: upsert(store, spark.createDataFrame(rows, change), batch, ["k"], 3, "stamp", [F.col("stamp"), F.col("v")])
    rows = lambda: sorted(((r["k"], r["v"], r["stamp"]) for r in store.read().collect()), key=str)
    assert put([("a", 1, 1, None), ("b", 1, 1, 5), (None, 7, 1, None)], 0)  # b expects a row that is not there
    assert rows() == [("a", 1, 1), (None, 7, 1)] or rows() == sorted([("a", 1, 1), (None, 7, 1)], key=str)
    assert put([("a", 2, 2, 1), ("a", 9, 1, 1), ("c", 3, 1, None)], 1)  # the last of two changes counts
    assert put([("a", 5, 3, 1), (None, 8, 2, 1)], 2)  # a stale expectation
    held = rows()
    assert held == sorted([("a", 2, 2), ("c", 3, 1), (None, 8, 2)], key=str)
    assert not put([("a", 100, 9, 2)], 2) and rows() == held
    assert put([], 3) and rows() == held


def test_a_stream_of_upserts_that_starts_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "k string, v long")
    batches = [spark.createDataFrame([("a", i), (f"k{i}", i)], "k string, v long") for i in range(3)]
    stream, sink = stream_of(spark, tmp_path / "in", batches), upsert_sink(store, ["k"], 4)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    sink(batches[0].withColumn("v", F.lit(-1).cast("long")), 2)  # a batch that comes again
    assert {r["k"]: r["v"] for r in store.read().collect()} == {"a": 2, "k0": 0, "k1": 1, "k2": 2}


# --- live sessions and alerts

SESSION = "event_id long, ts timestamp, k string, opens boolean, status string, outside boolean"


def sessions_by_hand(rows, gap, life):
    """The rules as one reads them, one session after another."""
    out, alive = {}, {}
    for i, ts, k, opens, status, outside in sorted((r for r in rows if r[2] and r[1]), key=lambda r: (r[1], r[0])):
        s = alive.get(k)
        if s and s["end"] <= ts:
            s = alive.pop(k) and None
        if not s and not opens:
            out[i] = ("missing", None)
        elif not s:
            alive[k] = {"status": "walking", "last": None, "end": ts + life}
            out[i] = ("opened", "walking")
        elif s["status"] == "ended":
            out[i] = ("ended", "ended")
        elif outside:
            out[i] = ("outside", s["status"])
        elif status in (None, s["status"]) and s["last"] and ts - s["last"] < gap:
            out[i] = ("throttled", s["status"])
        else:
            s |= {"status": status or s["status"], "last": ts, "end": ts + life}
            out[i] = ("taken", s["status"])
    return out


def session_rows(seed, n=250):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = T0 + timedelta(seconds=rng.choice([0, 1, 2, 3, 4]) + 3 * rng.randrange(60)) + timedelta(hours=2 * rng.randrange(3) + rng.choice([0, 6]))
        rows.append((i, ts, rng.choice("abcd"), rng.random() < 0.05, rng.choice([None, None, None, "walking", "arrived", "ended" if rng.random() < 0.2 else None]), rng.choice([None, False, False, False, True])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions_follow_the_rules(spark, seed):
    rows = session_rows(seed) + [(900, None, "a", True, None, None), (901, T0, None, True, None, None)]
    got = {r["event_id"]: (r["outcome"], r["status"]) for r in live.session_updates(spark.createDataFrame(rows, SESSION), "k").collect()}
    assert got == sessions_by_hand(rows, timedelta(seconds=3), timedelta(hours=6))
    assert live.session_updates(spark.createDataFrame([], SESSION), "k").count() == 0


def test_session_rules_one_by_one(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        (0, at(0), "a", True, None, None), (1, at(1), "a", False, None, None), (2, at(2), "a", False, None, None), (3, at(2), "a", False, "arrived", None), (4, at(3), "a", False, "arrived", None),
        (5, at(5), "a", False, None, True), (6, at(5), "a", False, "ended", None), (7, at(100), "a", False, "walking", None), (8, at(100), "a", True, None, None),
        (9, at(5 + 6 * 3600 - 1), "a", False, None, None), (10, at(5 + 6 * 3600), "a", False, None, None), (11, at(5 + 6 * 3600), "a", True, None, None),
    ]
    got = [(r["outcome"], r["status"]) for r in live.session_updates(spark.createDataFrame(rows, SESSION), "k").orderBy("event_id").collect()]
    assert got == [
        ("opened", "walking"), ("taken", "walking"), ("throttled", "walking"), ("taken", "arrived"), ("throttled", "arrived"), ("outside", "arrived"), ("taken", "ended"),
        ("ended", "ended"), ("ended", "ended"), ("ended", "ended"), ("missing", None), ("opened", "walking"),
    ]


def test_stream_sessions_equal_batch(rocks, tmp_path):
    rows = session_rows(5, 120)
    rng = random.Random(1)
    order = [r for _, r in sorted((r[1] + timedelta(minutes=50 * rng.random()), r) for r in rows)]
    end = [(1000 + i, T0 + NEVER * (i + 1), "z", False, None, None) for i in range(2)]
    batches = [rocks.createDataFrame(order[i : i + 40], SESSION) for i in range(0, 120, 40)] + [rocks.createDataFrame([r], SESSION) for r in end]
    stream = stream_of(rocks, tmp_path / "in", batches).withWatermark("ts", "1 hour")
    got = run(live.stream_session_updates(stream, "k", "string"), tmp_path, "sessions").where("event_id < 1000").collect()
    expected = live.session_updates(rocks.createDataFrame(rows, SESSION), "k").collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(map(tuple, expected))


POSITIONS, ALERTS = "event_id long, ts timestamp, k string, path long, along double", "path long, alert long, start double, end double"


def walks(seed, n=5, steps=80):
    rng, rows, i = random.Random(seed), [], 0
    alerts = [(p, a, 120.0 * a + rng.randrange(90), 0.0) for p in range(2) for a in range(6)]
    alerts = [(p, a, s, s + rng.choice([20, 80, 200])) for p, a, s, _ in alerts]
    for k in range(n):
        t, along = T0 + timedelta(hours=rng.randrange(3)), 0.0
        for _ in range(steps):
            t, along = t + timedelta(seconds=rng.choice([2, 5, 9])), along + rng.choice([-5, 6, 12])
            rows.append((i, t, f"w{k}", k % 2, along))
            i += 1
    return rows, alerts


def alerts_by_hand(rows, alerts):
    out, last, spoken = set(), {}, set()
    for i, t, k, path, along in sorted(rows, key=lambda r: (r[1], r[0])):
        if k in last and t - last[k] < timedelta(seconds=45):
            continue
        for p, a, start, end in sorted(alerts):
            if p == path and (k, a) not in spoken and start - 60 <= along < end:
                out.add((i, a))
                last[k] = t
                spoken.add((k, a))
                break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_are_spoken_once_and_not_too_often(spark, seed):
    rows, alerts = walks(seed)
    got = live.due_alerts(spark.createDataFrame(rows, POSITIONS), spark.createDataFrame(alerts, ALERTS), "k").collect()
    assert {tuple(r) for r in got} == alerts_by_hand(rows, alerts) and len(got) > 8


def test_a_walk_that_paused_is_another(spark):
    rows = [(i, T0 + timedelta(hours=h), "a", 0, 10.0) for i, h in enumerate([0, 1, 7, 14])]
    got = live.due_alerts(spark.createDataFrame(rows, POSITIONS), spark.createDataFrame([(0, 1, 50.0, 60.0)], ALERTS), "k").collect()
    assert {tuple(r) for r in got} == {(0, 1), (3, 1)}


def test_stream_alerts_equal_batch(rocks, tmp_path):
    rows, alerts = walks(3, 4, 40)
    rng = random.Random(1)
    order = [r for _, r in sorted((r[1] + timedelta(seconds=100 * rng.random()), r) for r in rows)]
    end = [(10_000 + i, T0 + NEVER * (i + 1), "z", 0, 0.0) for i in range(2)]
    batches = [rocks.createDataFrame(order[i : i + 60], POSITIONS) for i in range(0, 160, 60)] + [rocks.createDataFrame([r], POSITIONS) for r in end]
    table = rocks.createDataFrame(alerts, ALERTS)
    stream = stream_of(rocks, tmp_path / "in", batches).withWatermark("ts", "2 minutes")
    got = run(live.stream_due_alerts(stream, table, "k", "string"), tmp_path, "alerts").where("event_id < 10000").collect()
    assert {(r["event_id"], r["alert"]) for r in got} == {tuple(r) for r in live.due_alerts(rocks.createDataFrame(rows, POSITIONS), table, "k").collect()}


def test_duplicates_by_wide_tiles_equal_the_batch(rocks, tmp_path):
    rows = shuffled_within(crash_rows(3), timedelta(minutes=50), 3)
    batches = [rocks.createDataFrame(rows[i : i + 60], EVENTS) for i in range(0, len(rows), 60)]
    links = late.stream_links(stream_of(rocks, tmp_path / "in", batches).withWatermark("ts", "1 hour"), 20.0, 1800, tile=4, block=3)
    q = links.writeStream.outputMode("append").format("memory").queryName("wide").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        events = rocks.createDataFrame(rows, EVENTS).where("collision_id is null")
        expected = {tuple(r) for r in ingest.duplicate_links(events, 20.0, 1800).collect()}
        plain = {r["id"] for r in events.collect()}
        got = [tuple(r) for r in rocks.table("wide").collect()]
        assert expected <= set(got) and len(got) == len(set(got)) and {p for p in got if plain.issuperset(p)} == expected
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert max(kept) < 2 * len(rows)
    finally:
        q.stop()
