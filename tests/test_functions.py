"""Scalar functions on values whose results are known."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meridian.functions import geo, text, times


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(v, kind="string"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(("raw", "expected"), [("(K) Fatal Injury", "K"), ("(O) none", "O"), ("K", None), ("(X) odd", None), (None, None)])
def test_severity(spark, raw, expected):
    assert value(spark, text.severity_letter(lit(raw))) == expected


@pytest.mark.parametrize(("raw", "expected"), [(" 12 ", "12"), ("12a", None), ("", None), (None, None)])
def test_digits(spark, raw, expected):
    assert value(spark, text.digits_only(lit(raw))) == expected


@pytest.mark.parametrize(("raw", "n"), [("One. Two! Three?", 3), ("3.5 is one", 1), ("", 0), (None, 0), ("...", 0), ("a.b c.", 1)])
def test_sentences(spark, raw, n):
    assert value(spark, text.sentence_count(lit(raw))) == n


def test_facilities(spark):
    def tags(**kv):
        return F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k.replace("_", ":") if k.startswith("cycleway_") else k, v)])

    assert value(spark, text.facility_class(tags(highway="cycleway"))) == 3
    assert value(spark, text.facility_class(tags(highway="path", bicycle="designated"))) == 3
    assert value(spark, text.facility_class(tags(highway="path"))) == 0
    assert value(spark, text.facility_class(tags(cycleway="lane; shared_lane"))) == 2
    assert value(spark, text.city_facility_class(lit("Shared-Use Path"), lit("Existing"))) == 3
    assert value(spark, text.city_facility_class(lit("Shared-Use Path"), lit("Planned"))) == 0
    assert value(spark, text.city_facility_class(lit(None), lit("Existing"))) == 0


def test_text_errors(spark):
    said = "It is safe. See https://x.y for 12 and 13. " + "x" * 420
    got = value(spark, text.text_errors(F.lit(said), F.array(F.lit(12.0)), max_sentences=1))
    assert got == ["too_long", "too_many_sentences", "banned:safe", "link", "unknown_number:13.0"]
    assert value(spark, text.error_kinds(F.array(F.lit("unknown_number:13.0"), F.lit("unknown_number:2"), F.lit("link")))) == ["unknown_number", "link"]
    assert value(spark, text.text_errors(F.lit("Fine."), F.array(F.lit(1.0)))) == []


@pytest.mark.parametrize(
    ("local", "utc"),
    [
        ("2022-07-01 12:00:00", "2022-07-01 16:00:00"),
        ("2022-01-01 12:00:00", "2022-01-01 17:00:00"),
        ("2022-11-06 01:30:00", None),  # happens twice
        ("2022-03-13 02:30:00", "2022-03-13 07:00:00"),  # never happens
        ("2022-11-06 00:30:00", "2022-11-06 04:30:00"),
        ("2022-11-06 02:30:00", "2022-11-06 07:30:00"),
    ],
)
def test_local_times(spark, local, utc):
    got = value(spark, times.local_to_instant(F.lit(local).cast("timestamp")))
    assert got == (utc and datetime.fromisoformat(utc))


def test_parse_local_takes_the_first_format_that_fits(spark):
    formats = ["MM/dd/yyyy hh:mm a", "yyyy-MM-dd h:mm:ss a"]
    assert value(spark, times.parse_local(F.lit("07/01/2022 12:00 PM"), formats)) == datetime(2022, 7, 1, 16)
    assert value(spark, times.parse_local(F.lit("2022-07-01 1:00:00 PM"), formats)) == datetime(2022, 7, 1, 17)
    assert value(spark, times.parse_local(F.lit("nonsense"), formats)) is None


def test_light(spark):
    at = lambda s: value(spark, times.light(F.lit(s).cast("timestamp")))
    assert at("2024-06-21 17:00:00") == "day"
    assert at("2024-06-21 06:00:00") == "dark"
    assert at("2024-12-21 22:45:00") == "twilight"  # 17:45 in winter, a quarter of an hour after sunset
    noon = value(spark, times.sun_elevation(F.lit("2024-06-20 17:39:00").cast("timestamp")))
    assert abs(noon - (90 - 33.7756 + 23.44)) < 0.05


def test_similarities(spark):
    f = lambda a, b: value(spark, times.hour_similarity(F.lit(float(a)), F.lit(float(b))))
    assert [f(8, 8), f(8, 9), f(8, 10), f(8, 11), f(23.5, 0.5)] == [1, 1, 0.5, 0, 1]
    g = lambda a, b: value(spark, times.day_similarity(F.lit(a), F.lit(b)))
    assert [g(0, 0), g(0, 4), g(5, 6), g(4, 5)] == [1, 0.6, 0.6, 0.2]


def path(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_paths(spark):
    p = path((0, 0), (3, 4), (3, 14))
    assert value(spark, geo.path_length(p)) == 15
    assert tuple(value(spark, geo.midpoint(p))) == (3, 6.5)
    assert tuple(value(spark, geo.point_at(p, F.lit(99.0)))) == (3, 14)
    assert tuple(value(spark, geo.point_at(p, F.lit(2.5)))) == (1.5, 2)
    assert tuple(value(spark, geo.midpoint(path((1, 2))))) == (1, 2)
    assert [tuple(q) for q in value(spark, geo.densify(F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(0.0), 20))] == [(0, 0), (50 / 3, 0), (100 / 3, 0), (50, 0)]
    assert value(spark, geo.thin(F.array(*map(F.lit, range(10))), 4)) == [0, 3, 6, 9]


def test_polygon_with_a_hole(spark):
    rings = F.array(path((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), path((4, 4), (6, 4), (6, 6), (4, 6), (4, 4)))
    inside = lambda x, y: value(spark, geo.in_polygon(F.lit(float(x)), F.lit(float(y)), rings))
    assert [inside(1, 1), inside(5, 5), inside(11, 5), inside(9, 9)] == [True, False, False, True]


def test_hexagons_cover_their_centres(spark):
    for q, r in [(0, 0), (3, -2), (-5, 7)]:
        x, y = geo.hex_center(F.lit(float(q)), F.lit(float(r)), 10.0)
        assert tuple(value(spark, F.struct(*geo.hex_cell(x, y, 10.0)))) == (q, r)


def test_haversine(spark):
    d = value(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert math.isclose(d, 6_371_000 * math.pi / 180)


def test_utm(spark):
    x, y = geo.utm(F.lit(33.7756), F.lit(-84.3963))
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert got["x"] == pytest.approx(741_154, abs=60) and got["y"] == pytest.approx(3_740_300, abs=400)
    x, y = geo.utm(F.lit(0.0), F.lit(-87.0))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((500_000, 0), abs=1e-6)


def test_buffer_and_stitching(spark):
    square = F.array(path((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)))
    inside = lambda x, m: value(spark, geo.in_buffer(F.lit(float(x)), F.lit(5.0), square, m))
    assert [inside(5, 1.0), inside(12, 2.0), inside(12, 1.0)] == [True, True, False]
    a, b = path((0, 0), (1, 0)), path((5, 5), (1, 0))
    assert [tuple(p) for p in value(spark, geo.stitched(a, geo.oriented(b, F.lit(1.0), F.lit(0.0)), 0.1))] == [(0, 0), (1, 0), (5, 5)]


def test_labels_and_dates(spark):
    assert value(spark, times.time_label(F.lit("2024-07-01 02:00:00").cast("timestamp"))) == "10 PM"
    got = value(spark, times.reference_dates(F.lit("2024-01-06").cast("date")))  # a Saturday
    assert {k: v.isoformat() for k, v in got.items()} == {"saturday": "2024-01-06", "sunday": "2024-01-07", "weekday": "2024-01-08", "friday": "2024-01-12"}
    cell = value(spark, times.cell_at(F.lit("2024-07-06 03:00:00").cast("timestamp"), F.lit(True)))
    assert tuple(cell) == ("friday", 23, "dark", True)
    one = text.alert_sentence(F.array(F.lit("A")), F.lit(0.0), F.lit(40.0), F.lit(1))
    two = text.alert_sentence(F.array(F.lit("A"), F.lit("B")), F.lit(0.0), F.lit(144.0), F.lit(2))
    assert value(spark, one) == "Higher risk on A" and value(spark, two) == "2 stretches over the next 140 meters: A, B"


@pytest.mark.parametrize("raw", ["1,2,3", "a,b,c,d", "1,1,0,2", "0,0,1,1", "nan,0,0.1,0.1"])
def test_bad_boxes(raw):
    with pytest.raises(ValueError):
        text.parse_bbox(raw)
    assert text.parse_bbox("0,0,0.1,0.2") == (0, 0, 0.1, 0.2)
