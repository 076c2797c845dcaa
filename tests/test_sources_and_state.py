"""Readers, writers, streams and their batch twins."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meridian.sources import readers, sinks
from meridian.streaming import state

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, k, T0 + timedelta(seconds=s)) for i, (k, s) in enumerate(rows)], "event_id long, k string, ts timestamp")


def test_layers(spark, tmp_path):
    spark.range(10).withColumn("b", F.lit(1)).write.parquet(str(tmp_path / "a"))
    layers = [readers.Layer("good", str(tmp_path / "a"), ["id"], "id > 6"), readers.Layer("bad", str(tmp_path / "none"))]
    done, failed = readers.register_layers(spark, layers)
    assert done == ["good"] and list(failed) == ["bad"]
    assert spark.table("good").columns == ["id"] and spark.table("good").count() == 3


def test_features(spark):
    rows = [json.dumps({"attributes": {"a": "1"}, "geometry": g}) for g in ({"x": 1.0, "y": 2.0}, {"paths": [[[0, 0], [1, 1]], [[5, 5]]]}, None)] + ["nonsense"]
    f = readers.flatten_features(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert [(r["lon"], r["lat"]) for r in f.collect()][0] == (1.0, 2.0)
    assert readers.line_parts(f).select(F.size("path")).collect() == [(2,)]
    got = readers.nan_to_null(spark.createDataFrame([(float("nan"), 1), (1.0, 2)], "v double, i int")).agg(F.avg("v")).first()[0]
    assert got == 1.0


def test_load_or_build(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.load_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert calls == [1]


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    a = sinks.write_version({"t": spark.range(5), "u": spark.range(2)}, root, "v1")
    b = sinks.write_version({"t": spark.range(5).repartition(3), "w": spark.range(2)}, root, "v2", "v1")
    assert sorted(map(tuple, sinks.changed_tables(a, b).collect())) == [("u", "removed"), ("w", "added")]
    sinks.point_to(spark, root, "v2")
    assert sinks.current(spark, root) == "v2"
    got = sinks.read_version(spark, root, "v2", ["t"], ["gone"])
    assert got["t"].count() == 5 and got["gone"] is None
    with pytest.raises(ValueError):
        sinks.read_version(spark, root, "v2", ["u"])
    spark.range(6).write.mode("overwrite").parquet(f"{root}/v2/t")
    with pytest.raises(ValueError):
        sinks.read_version(spark, root, "v2", ["t"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_version({"t": spark.range(1)}, root, "v2")


def test_partitioned_writes(spark, tmp_path):
    df = spark.createDataFrame([(i, T0 + timedelta(days=i)) for i in range(200)], "id int, ts timestamp")
    path = str(tmp_path / "p")
    sinks.write_partitioned(df, path, "ts", order=["id"])
    assert spark.read.parquet(path).select("chunk").distinct().count() == 3
    chunk = spark.read.parquet(path).where("id = 0").first()["chunk"]
    sinks.replace_partition(spark.read.parquet(path).where(F.col("chunk") == chunk).limit(1).cache(), path, ["chunk"])
    left = spark.read.parquet(path)
    assert left.where(F.col("chunk") == chunk).count() == 1 and left.where(F.col("chunk") != chunk).count() > 100


def test_geojson(spark):
    path = F.array(F.struct(F.lit(1.1234567).alias("x"), F.lit(2.0).alias("y")))
    got = json.loads(spark.range(1).select(sinks.geojson(path, F.create_map(F.lit("a"), F.lit(1)))).first()[0])
    assert got == {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1.12346, 2.0]]}, "properties": {"a": 1}}


def test_checked_merge(spark):
    now = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, None, "c")], "k int, at int, v string")
    up = spark.createDataFrame([(1, 11, "A", 10), (2, 21, "B", 19), (3, 31, "C", None)], "k int, at int, v string, expected int")
    assert sorted(map(tuple, sinks.merge_checked(now, up, "k", "at").collect())) == [(1, 11, "A"), (2, 20, "b"), (3, 31, "C")]


def greedy(rows, seconds, most=None):
    out, kept = [], {}
    for i, (k, s) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        mine = [t for t in kept.get(k, []) if (s - t <= seconds if most else s - t < seconds)]
        if len(mine) < (most or 1):
            mine.append(s)
            out.append(i)
        kept[k] = mine
    return sorted(out)


ROWS = [(k, s) for k in "ab" for s in (0, 1, 2, 4, 5, 9, 9, 30, 31, 33, 34, 60, 61, 62, 63)]


def test_throttle_and_limit(spark):
    e = events(spark, ROWS)
    assert sorted(r[0] for r in state.throttle(e, "k", 3.0).collect()) == greedy(ROWS, 3)
    assert sorted(r[0] for r in state.sliding_limit(e, "k", 10.0, 2).collect()) == greedy(ROWS, 10, 2)
    assert state.throttle(e.limit(0), "k").count() == 0
    edge = events(spark, [("a", 0), ("a", 60), ("a", 61)])  # one that is exactly as old as the window still counts
    assert sorted(r[0] for r in state.sliding_limit(edge, "k", 60.0, 1).collect()) == [0, 2]


def test_reports_expire_and_start_anew(spark):
    day = 86_400
    e = events(spark, [("a", 0), ("a", 3 * day), ("a", 20 * day), ("b", 0)])
    ttl = F.expr("interval 14 days")
    got = {r["k"]: r for r in state.upsert_reports(e, ["k"], ttl).collect()}
    assert got["a"]["confirmations"] == 1 and got["a"]["created_at"] == T0 + timedelta(days=20)
    now = F.lit(T0 + timedelta(days=15))
    assert [r["k"] for r in state.active(state.upsert_reports(e, ["k"], ttl), now).collect()] == ["a"]


def test_as_of(spark):
    facts = events(spark, [("a", 0), ("a", 100), ("b", 50)]).withColumnRenamed("event_id", "v")
    asks = events(spark, [("a", 99), ("a", 100), ("a", 250), ("a", 161), ("b", 49), ("c", 5)]).withColumn("extra", F.lit(1))
    got = {r["event_id"]: r["v"] for r in state.as_of(asks, facts, ["k"], "v", 100).collect()}
    assert got == {0: 0, 1: 1, 2: None, 3: 1, 4: None, 5: None}


def run_stream(spark, tmp_path, make, files, name, mode):
    source = tmp_path / "in"
    source.mkdir()
    for i, df in enumerate(files):
        df.coalesce(1).write.mode("append").parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_stream_rollup_equals_batch(spark, tmp_path):
    e = events(spark, [("a", s) for s in (0, 10, 3700, 7300)]).withColumn("value", F.lit(2.0))
    out = run_stream(spark, tmp_path, lambda s: state.stream_hourly(s, "k"), [e], "hours", "update")
    got = sorted((r["bucket"], r["n"], r["total"]) for r in out.collect())
    assert got == [(T0, 2, 4.0), (T0 + timedelta(hours=1), 1, 2.0), (T0 + timedelta(hours=2), 1, 2.0)]


def test_stream_distinct(spark, tmp_path):
    e = events(spark, [("a", 0), ("a", 5), ("b", 1)])
    assert run_stream(spark, tmp_path, lambda s: state.stream_distinct(s, ["k"]), [e], "once", "append").count() == 2


def test_stream_throttle_equals_batch(spark, tmp_path):
    e = events(spark, ROWS)
    out = run_stream(spark, tmp_path, lambda s: state.stream_throttle(s, "k", "string", 3.0), [e], "ok", "append")
    assert sorted(r["event_id"] for r in out.collect()) == greedy(ROWS, 3)


def test_stream_reports_equal_batch(spark, tmp_path):
    day = 86_400
    e = events(spark, [("a", 0), ("a", 3 * day), ("a", 20 * day), ("b", 0)])
    make = lambda s: state.stream_reports(s.withWatermark("ts", "1 day"), ["k"], "k string", 14 * day * 1000)
    out = run_stream(spark, tmp_path, make, [e], "reports", "update")
    got = {r["k"]: (r["created_ms"], r["confirmations"]) for r in out.collect()}
    start = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert got == {"a": (start + 20 * day * 1000, 1), "b": (start, 1)}


def test_feature_server_pages(spark, monkeypatch):
    asked = []

    def get(self, **more):
        asked.append(more)
        if more.get("returnCountOnly"):
            return {"count": 5}
        first = more["resultOffset"]
        return {"features": [{"attributes": {"i": i}} for i in range(first, min(5, first + more["resultRecordCount"]))]}

    monkeypatch.setattr(readers.FeatureServerReader, "get", get)
    monkeypatch.setattr(readers.FeatureServerReader, "layer", lambda self: {"objectIdField": "oid"})
    r = readers.FeatureServerReader({"url": "http://x", "pageSize": "2", "where": "a > 1"})
    got = [json.loads(v[0])["attributes"]["i"] for p in r.partitions() for v in r.read(p)]
    assert got == [0, 1, 2, 3, 4] and r.query["where"] == "a > 1" and len(asked) == 4


def test_map_extract(spark, tmp_path):
    rows = [{"type": "node", "id": i, "lat": 0.0, "lon": i / 1000, "tags": t} for i, t in enumerate([{}, {"amenity": "police"}, {"amenity": "cafe"}, {"railway": "station"}])]
    rows += [{"type": "way", "id": 9, "nodes": [0, 1, 1, 2, 77], "tags": {"highway": "path"}}, {"type": "way", "id": 10, "nodes": [2, 3], "tags": {"building": "yes"}}, {"type": "way", "id": 11, "nodes": [3], "tags": {"highway": "x"}}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nno json\n")
    elements = readers.map_elements(spark, str(tmp_path))
    assert elements.count() == 7
    assert {r["id"] for r in readers.map_features(elements, {"amenity": ["police"], "railway": []}).collect()} == {1, 3}
    nodes, edges = readers.map_network(elements)
    assert {(r["way"], r["pos"], r["u"], r["v"]) for r in edges.collect()} == {(9, 0, 0, 1), (9, 2, 1, 2)} and {r["id"] for r in nodes.collect()} == {0, 1, 2}
    assert edges.first()["length"] == pytest.approx(111.2, rel=0.01)


def test_weather_over_the_change_of_clocks(spark):
    rows = [("2024-11-03 00:00:00", 0.1), ("2024-11-03 01:00:00", 0.2), ("2024-03-10 02:00:00", 0.3), ("2024-03-10 03:00:00", 0.1), (None, 9.0)]
    local = spark.createDataFrame(rows, "t string, precip double").select(F.to_timestamp("t").alias("time"), "precip")
    got = {str(r["time"]): r["precip"] for r in readers.hourly_weather(local).collect()}
    assert got == {"2024-11-03 04:00:00": 0.1, "2024-03-10 07:00:00": 0.3}


def test_throttle_holds_no_key_in_memory(spark):
    events = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("event_id"), F.timestamp_seconds(F.floor(F.col("id") / 2)).alias("ts"))
    got = {r["event_id"] for r in state.throttle(events, "k", 3.0).collect()}
    assert got == {i for i in range(3000) if i // 2 % 3 == 0}
    kept = {r["event_id"] for r in state.sliding_limit(events, "k", 10.0, 4).collect()}
    assert kept == {i for i in range(3000) if i // 2 % 11 < 4}
    plan = state.throttle(events, "k", 3.0)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan
