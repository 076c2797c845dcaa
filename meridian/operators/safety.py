"""Signals of personal safety: incidents, places of help, lighting, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meridian.functions import times
from meridian.operators.ranking import even_quantiles
from meridian.operators.scoring import rate_bands
from meridian.plans.scratch import Scratch

# Fixed values.
OFFENCES = {
    "Murder & Nonnegligent Manslaughter": "Homicide", "Robbery": "Robbery", "Aggravated Assault": "Aggravated assault", "Simple Assault": "Simple assault",
}
PRIVATE_PLACES = ["RESIDENCE_HOME", "APARTMENT", "JAIL_PRISON_PENITENTIARY_CORRECTIONS_FACILITY", "SHELTER_MISSION_HOMELESS"]
HELP_AMENITIES = {"police": "police", "fire_station": "fire", "hospital": "hospital"}
HELP_NAMES = {"blue_light": "Emergency call box", "police": "Police station", "fire": "Fire station", "hospital": "Hospital", "station": "Rail station"}


def _pick(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def public_incidents(raw: DataFrame, bounds: tuple[float, float, float, float], zone: str = times.ZONE) -> DataFrame:
    """(category, occurred, local_day, day_part, lat, lon) of offences against people in public places.

    A null place is kept: only what is known to be private goes. Rows without an instant or
    a position within (west, south, east, north) go.
    """
    west, south, east, north = bounds
    keep = F.col("offense").isin(list(OFFENCES)) & ~F.coalesce(F.col("place").isin(PRIVATE_PLACES), F.lit(False)) & F.col("epoch_ms").isNotNull()
    rows = raw.where(keep & F.col("lat").between(south, north) & F.col("lon").between(west, east))
    at = F.timestamp_millis("epoch_ms")
    local = F.from_utc_timestamp(at, zone)
    return rows.select(
        _pick(OFFENCES, F.col("offense")).alias("category"), at.alias("occurred"), F.to_date(local).alias("local_day"),
        times.day_part(F.hour(local)).alias("day_part"), "lat", "lon",
    )


def _named(name: Column, kind: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), _pick(HELP_NAMES, kind))


def call_boxes(raw: DataFrame) -> DataFrame:
    """(kind, name, lat, lon) of boxes that work and stand outside."""
    rows = raw.where("phone_status = 'Active' and location_code = 'Outside'").withColumn("kind", F.lit("blue_light"))
    return rows.select("kind", _named(F.col("phone_name"), F.col("kind")).alias("name"), "lat", "lon")


def help_places(raw: DataFrame, agency: list[str]) -> DataFrame:
    """(kind, name, lat, lon) of map features: police, fire and hospitals, and stations of an agency, by network or operator."""
    labels = F.upper(F.concat_ws(" ", "network", "operator"))
    ours = F.lit(False)
    for a in agency:
        ours = ours | labels.contains(a.upper())
    kind = F.coalesce(_pick(HELP_AMENITIES, F.col("amenity")), F.when((F.col("railway") == "station") & ours, "station"))
    rows = raw.withColumn("kind", kind).where("kind is not null")
    return rows.select("kind", _named(F.col("name"), F.col("kind")).alias("name"), "lat", "lon")


def thin_points(points: DataFrame, radius: float, by: list[str], first: Column | None = None) -> DataFrame:
    """`points` (id, x, y) without those within `radius` of an earlier one that stays, for each `by`.

    Earlier is a smaller `first` (the id, if not given), which must differ between points. Points without a finite position are near nothing and stay; null
    values of `by` are a group. What stays depends on what stayed before; it is found in rounds for all points at once: a
    point with no earlier one near it that is undecided stays, and what is near it goes. Cells are
    so small that the points of one are all near each other, so of each cell only the first can stay in a
    round and only it is compared with the cells around: a crowded cell makes no pairs within itself. A round decides at least the
    first of each chain of near points; where the order runs along a chain, it takes as many rounds as the chain has links.
    """
    sound = F.coalesce(F.expr("abs(x) < double('infinity') and abs(y) < double('infinity')"), F.lit(False))
    scratch, size = Scratch(points.sparkSession), radius / 2**0.5
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    key = ["g", "cx", "cy"]
    left = points.where(sound).select("id", "x", "y", F.struct(*by, F.lit(0).alias("__")).alias("g"), cell("x").alias("cx"), cell("y").alias("cy"), (F.col("id") if first is None else first).alias("first"))
    left, kept = scratch.write(left), None
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-2, 3) for j in range(-2, 3)])

    def near(these: DataFrame) -> DataFrame:
        """Undecided points with each of `these` within the radius, as t. Copies of `these` go to 25 cells, which no size of a file tells, so no side is broadcast."""
        sent = these.select("g", F.struct("id", "x", "y", "first").alias("t"), "cx", "cy", F.explode(around).alias("d"))
        sent = sent.select("g", "t", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
        return left.join(sent.hint("merge"), key).where(F.hypot(F.col("x") - F.col("t.x"), F.col("y") - F.col("t.y")) <= radius)

    while not left.isEmpty():
        heads = scratch.write(left.groupBy(*key).agg(F.min_by(F.struct("id", "x", "y", "first"), "first").alias("h")).select(*key, "h.*"))
        blocked = near(heads).where(F.col("first") < F.col("t.first")).select(F.col("t.id").alias("id")).distinct()
        stay = scratch.write(heads.join(blocked, "id", "left_anti"))
        kept = stay.select("id") if kept is None else kept.unionByName(stay.select("id"))
        gone = near(stay).select("id").distinct()
        old, left = left, scratch.write(left.join(gone, "id", "left_anti"))
        scratch.free(old, heads)
    if kept is None:
        return points
    decided = points.where(sound).join(kept, "id", "left_semi")
    return decided.unionByName(points.where(~sound)).select(*points.columns)


def lamp_points(sources: list[DataFrame]) -> DataFrame:
    """(x, y) of the lamps of all sources; those without a position are dropped."""
    out = sources[0].select("x", "y")
    for s in sources[1:]:
        out = out.unionByName(s.select("x", "y"))
    return out.dropna()


def edge_lighting(own: Column, segment: Column, lamp: Column) -> Column:
    """An edge's own tag, else its segment's, else lit if a lamp is near; -1 unknown."""
    known = lambda c: F.when(c >= 0, c)
    return F.coalesce(known(own), known(segment), F.when(lamp, 1), F.lit(-1))


def incident_bands(df: DataFrame, count: str, rate: str, part: str = "day_part", sure: float = 0.9) -> DataFrame:
    """`df` (one row per area and day part) with exposure and band: how its count compares with the mean rate of its part.

    Exposure is the hourly `rate` of people times the hours of the part; an unknown rate is the part's median, and none is below a
    millionth. Each part has a prior of its own, see `scoring.rate_bands`. Rows of an unknown part have null exposure and are typical.
    """
    hours = F.create_map(*[F.lit(x) for k, h in times.DAY_PARTS.items() for x in (k, float(len(h)))])[F.col(part)]
    medians = even_quantiles(df.where(F.col(part).isNotNull()), rate, 3, [part]).where("i = 1").select(part, F.col("q").alias("__m"))
    rows = df.join(F.broadcast(medians), part, "left")  # one row a part
    rows = rows.withColumn("exposure", F.greatest(F.lit(1e-6), F.coalesce(F.col(rate), "__m")) * hours).select(*df.columns, "exposure")
    rows = Scratch(df.sparkSession).write(rows)
    out = rows.where(hours.isNull()).withColumns({"exposure": F.lit(None).cast("double"), "band": F.lit("typical")})
    for name in times.DAY_PARTS:
        out = out.unionByName(rate_bands(rows.where(F.col(part) == name), count, "exposure", sure))
    return out


def area_safety(areas: DataFrame, key: str, banded: DataFrame, activity: DataFrame, lit: DataFrame, places: DataFrame, part: str = "day_part") -> DataFrame:
    """One row per area (`key`): incidents_, band_ and activity_ for each day part, lit_share and places.

    `banded` (key, part, count, band) are incidents, `activity` (key, part, activity) bands of how busy it is, `lit` (key, share) and `places` (key, n) help
    points; each has a row where something is known. What is missing is 0 incidents or places, typical, unknown, and a null share.
    """
    names = list(times.DAY_PARTS)
    wide = banded.groupBy(key).pivot(part, names).agg(F.sum("count").alias("n"), F.first("band").alias("band"))
    busy = activity.groupBy(key).pivot(part, names).agg(F.first("activity"))
    busy = busy.select(key, *[F.col(n).alias(f"activity_{n}") for n in names])
    out = areas.select(key).join(wide, key, "left").join(busy, key, "left").join(lit.select(key, F.round("share", 3).alias("lit_share")), key, "left").join(places.select(key, F.col("n").alias("places")), key, "left")
    filled = [c for n in names for c in (F.coalesce(f"{n}_n", F.lit(0)).alias(f"incidents_{n}"), F.coalesce(f"{n}_band", F.lit("typical")).alias(f"band_{n}"), F.coalesce(f"activity_{n}", F.lit("unknown")).alias(f"activity_{n}"))]
    return out.select(key, *filled, "lit_share", F.coalesce("places", F.lit(0)).alias("places"))


def packed_short(c: Column) -> Column:
    """A whole number for 16 bits, halves to even, -1 for unknown."""
    return F.when(c.isNull(), -1).otherwise(F.least(F.lit(32767.0), F.greatest(F.lit(0.0), F.rint(c)))).cast("short")


def signal_factor(unlit: Column, quiet: Column, after_dark: Column) -> Column:
    """What an edge costs after dark: one more for unlit, half for quiet; what is unknown costs nothing."""
    dark = F.when(F.coalesce(unlit, F.lit(False)), 1.0).otherwise(0.0) + F.when(F.coalesce(quiet, F.lit(False)), 0.5).otherwise(0.0)
    return 1.0 + F.when(after_dark, dark).otherwise(0.0)
