"""Feed rules, safety signals, trips and answers on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meridian.operators import feeds, ingest, products, safety, trips  # noqa: F401  (feeds registers its rules)

PLACE = {"lat": 33.7, "lon": -84.4}


def one(spark, source, **columns):
    schema = ", ".join(f"`{k}` {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in (columns | PLACE).items())
    return ingest.normalize(source, spark.createDataFrame([tuple((columns | PLACE).values())], schema)).first()


@pytest.mark.parametrize(
    ("source", "columns", "expected"),
    [
        ("yearly", {"Crash_Year": 2021, "F__of_Pedestrians_per_crash": 1, "KABCO_Severity": "(A) x"}, {"ts": None, "year": 2021, "time_precision": "year", "is_ped": True, "severity": "A"}),
        ("ped_bike", {"Date_and_Time": 1656658800000, "Mode": "Bicyclist"}, {"ts": datetime(2022, 7, 1, 11), "is_ped": False, "is_bike": True}),
        ("all_modes", {"Date_and_Time": "07/01/2022 07:00 AM", "Collision_ID": "12x"}, {"ts": datetime(2022, 7, 1, 11), "is_ped": False, "collision_id": None}),
        ("downtown", {"Date_and_Time": "bad", "SHSP_Emphasis_Areas": "Pedestrians"}, {"ts": None, "is_ped": True}),
        ("midtown", {"Date_and_Time": "01/01/2022 12:00 PM", "Pedestrian_Related": "TRUE", "Name": "x", "Roadway": "R"}, {"ts": datetime(2022, 1, 1, 17), "is_ped": True, "road": "R"}),
        ("severe", {"Date_W_Time": 1656658800000, "TravelMode": "Scooter"}, {"ts": datetime(2022, 7, 1, 7), "is_ped": False, "is_bike": False}),
        ("campus", {"Date": "2022-07-01", "Time": " 1:00:00 PM", "Most_Harmful_Event__Crash_Level_": "Pedalcyclist"}, {"ts": datetime(2022, 7, 1, 17), "is_bike": True}),
        ("county", {"Date": "7/1/2022", "Time": "13:00", "Crash_Mode": "Pedestrian", "Collision_ID": " 77 "}, {"ts": datetime(2022, 7, 1, 17), "is_ped": True, "collision_id": "77"}),
    ],
)
def test_feeds(spark, source, columns, expected):
    row = one(spark, source, **columns).asDict()
    assert list(row) == list(ingest.CANONICAL) and row["source"] == source
    assert {k: row[k] for k in expected} == expected


def test_thinning_keeps_the_earlier_point(spark):
    rows = [(1, 0.0, 0.0, "a"), (2, 20.0, 0.0, "a"), (3, 40.0, 0.0, "a"), (4, 10.0, 0.0, "b"), (5, 500.0, 0.0, "a")]
    df = spark.createDataFrame(rows, "id long, x double, y double, kind string")
    assert sorted(r["id"] for r in safety.thin_points(df, 30.0, ["kind"]).collect()) == [1, 3, 4, 5]
    assert safety.thin_points(df.limit(0), 30.0, ["kind"]).count() == 0


def test_call_boxes(spark):
    rows = [("a", "Active", "Outside", 1.0, 2.0), (" ", "Active", "Outside", 1.0, 2.0), ("c", "Active", "Inside", 1.0, 2.0), ("d", None, "Outside", 1.0, 2.0)]
    got = safety.call_boxes(spark.createDataFrame(rows, "phone_name string, phone_status string, location_code string, lat double, lon double"))
    assert sorted(r["name"] for r in got.collect()) == ["Emergency call box", "a"]


def test_signal_costs(spark):
    row = spark.range(1).select(
        safety.signal_factor(F.lit(True), F.lit(True), F.lit(True)).alias("a"), safety.signal_factor(F.lit(True), F.lit(None).cast("boolean"), F.lit(False)).alias("b"),
        safety.packed_short(F.lit(2.5)).alias("c"), safety.packed_short(F.lit(None).cast("double")).alias("d"), safety.packed_short(F.lit(1e9)).alias("e"),
    ).first()
    assert tuple(row) == (2.5, 1.0, 2, -1, 32767)


def test_routines(spark):
    now = datetime(2024, 1, 31, 8, 30)
    rows = [("u", i, now - timedelta(days=7 * i), 0.0, 0.0 + i, 1000.0, 0.0) for i in range(1, 4)]
    rows += [("u", 9, now - timedelta(hours=3), 1000.0, 0.0, 0.0, 0.0), ("v", 10, now - timedelta(days=1), 0.0, 0.0, 1000.0, 0.0)]
    df = spark.createDataFrame(rows, "user string, trip long, at timestamp, x1 double, y1 double, x2 double, y2 double")
    placed = trips.place_clusters(df)
    assert placed.where("user = 'u'").select("start", "end").distinct().count() == 2
    got = trips.routines(placed, F.lit(now)).collect()
    assert [(r["user"], r["trips"]) for r in got] == [("u", 3)]
    assert got[0]["score"] == pytest.approx(sum(0.5 ** (i / 2) for i in range(1, 4)))
    far = trips.routines(placed, F.lit(now), F.lit(9000.0), F.lit(0.0)).first()
    assert far["score"] == pytest.approx(got[0]["score"] / 4)
    assert [(r["user"], r["trip"]) for r in trips.returns(df, F.lit(now)).collect()] == [("u", 9)]


def test_rail_handoff(spark):
    stations = spark.createDataFrame([(1, 0.0, 100.0), (2, 5000.0, 100.0)], "id long, x double, y double")
    walks = spark.createDataFrame([(1, 0.0, 0.0, 5000.0, 0.0, 4000.0), (2, 0.0, 0.0, 50.0, 0.0, 4000.0), (3, 0.0, 0.0, 5000.0, 0.0, 60.0)], "id long, x1 double, y1 double, x2 double, y2 double, duration double")
    assert list(map(tuple, trips.rail_handoffs(walks, stations).collect())) == [(1, 1, 2)]


def test_suggestions(spark):
    catalog = spark.createDataFrame([("speed", "slow"), ("lanes", "narrow"), ("history", "cross"), ("turns", "cross")], "factor string, suggestion string")
    rows = [(1, ["turns", "speed", "history"]), (2, ["other", None]), (3, []), (4, ["lanes", "speed", "turns"]), (5, None)]
    found = spark.createDataFrame(rows, "k int, factors array<string>")
    got = {r["k"]: r["suggestions"] for r in products.suggestions(found, catalog, "k", most=2).collect()}
    assert got == {1: ["cross", "slow"], 2: [], 3: [], 4: ["narrow", "slow"], 5: []}
