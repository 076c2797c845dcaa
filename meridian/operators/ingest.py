"""From overlapping raw feeds to one canonical table of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from meridian.functions import geo, text
from meridian.operators.graph import components_by_parts
from meridian.operators.spatial import cell_pairs
from meridian.plans.scratch import Scratch

#: The canonical columns and their types, in order.
CANONICAL = {
    "source": "string", "source_id": "string", "collision_id": "string", "ts": "timestamp", "year": "int", "time_precision": "string",
    "lat": "double", "lon": "double", "is_ped": "boolean", "is_bike": "boolean", "severity": "string", "light_report": "string",
    "surface_report": "string", "road": "string", "cross_road": "string",
}
PRIVATE = ["Name", "Age", "Sex", "Address", "Phone", "Narrative", "Details_411"]
SEVERITIES = ["K", "A", "B", "C", "O"]

#: Turns a raw feed into canonical expressions.
Rule = Callable[[DataFrame], dict[str, Column]]
RULES: dict[str, Rule] = {}


def rule(source: str) -> Callable[[Rule], Rule]:
    """Register how a feed is read."""

    def put(f: Rule) -> Rule:
        RULES[source] = f
        return f

    return put


def column(raw: DataFrame, name: str) -> Column:
    """A raw column, or nulls where a feed lacks it."""
    return F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")


def normalize(source: str, raw: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """A raw feed as canonical rows; an unknown source is a KeyError.

    Whatever a rule leaves out is null, flags are false where null, and columns that hold
    private data are dropped before the rule sees them. Precision is `year` where a row
    has no instant, else `minute`.
    """
    made = (RULES if rules is None else rules)[source](raw.drop(*PRIVATE))
    ts = made.get("ts", F.lit(None).cast("timestamp"))
    out = {
        "source": F.lit(source), "ts": ts, "year": made.get("year", F.year(ts)),
        "time_precision": F.when(ts.isNull(), "year").otherwise("minute"),
        "is_ped": F.coalesce(made.get("is_ped", F.lit(False)), F.lit(False)), "is_bike": F.coalesce(made.get("is_bike", F.lit(False)), F.lit(False)),
    }
    cols = {c: out.get(c, made.get(c, F.lit(None))) for c in CANONICAL}
    for c in ("lat", "lon"):
        cols[c] = F.nanvl(cols[c].cast("double"), F.lit(None).cast("double"))
    cols["collision_id"] = text.digits_only(cols["collision_id"].cast("string"))
    return raw.drop(*PRIVATE).select(*[cols[c].cast(t).alias(c) for c, t in CANONICAL.items()])


def union_sources(feeds: dict[str, DataFrame], rules: dict[str, Rule] | None = None) -> DataFrame:
    """All feeds in canonical form, one after another (UNION ALL)."""
    out = None
    for source, raw in feeds.items():
        one = normalize(source, raw, rules)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no feeds")
    return out


def bad_position(lat: Column, lon: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Why a position can't be used: missing, zero or outside (west, south, east, north); null if it can."""
    west, south, east, north = bounds
    zero = (F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)
    return (
        F.when(lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon), "missing")
        .when(zero, "zero")
        .when(~(lat.between(south, north) & lon.between(west, east)), "outside")
    )


def exact_dedupe(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per `key`, the first in `order`; rows with a null key stay."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    return first.unionByName(df.where(F.col(key).isNull()))


def duplicate_links(events: DataFrame, metres: float = 20.0, seconds: int = 1800) -> DataFrame:
    """(src, dst) of events that may be one: equal collision_id, or within both limits.

    `events` has id, x, y (metres), ts and collision_id. Rows of one collision_id are
    chained to its smallest id, not paired with each other. Rows that lack what a rule
    needs are not linked by it.
    """
    known = events.where("x is not null and y is not null and ts is not null").select("id", "x", "y", F.unix_timestamp("ts").alias("t"))
    return _near_links(known, metres, seconds).unionByName(_named_links(events)).distinct()


def _near_links(known: DataFrame, metres: float, seconds: int) -> DataFrame:
    near = cell_pairs(known, known, metres, extra=("t", float(seconds))).where("a.id < b.id")
    near = near.where(F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) <= metres)
    return near.where(F.abs(F.col("a.t") - F.col("b.t")) <= seconds).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


def _named_links(events: DataFrame) -> DataFrame:
    named = events.where("collision_id is not null")
    least = named.groupBy("collision_id").agg(F.min("id").alias("src"))
    return named.join(least, "collision_id").where("src <> id").select("src", F.col("id").alias("dst"))


def cluster_links(events: DataFrame, metres: float = 20.0, seconds: int = 1800) -> DataFrame:
    """(src, dst) that join what `duplicate_links` join: copies of a place and second are chained to the smallest id, and only those are paired."""
    place = ["x", "y", "t"]
    sound = "abs(x) < double('infinity') and abs(y) < double('infinity') and ts is not null"  # neither null nor NaN
    known = events.where(sound).select("id", "x", "y", F.unix_timestamp("ts").alias("t"))
    firsts = Scratch(events.sparkSession).write(known.groupBy(*place).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    copied = firsts.where("n > 1").select(*place, F.col("id").alias("src"))
    copies = known.join(copied.hint("merge"), place).where("src <> id").select("src", F.col("id").alias("dst"))
    return _near_links(firsts.select("id", *place), metres, seconds).unionByName(copies).unionByName(_named_links(events))


def cluster_events(events: DataFrame, links: DataFrame) -> DataFrame:
    """`events` with cluster: the smallest id of what it is linked to, over any number of links."""
    parts = components_by_parts(links).withColumnsRenamed({"node": "id", "component": "__c"})
    return events.join(parts.hint("merge"), "id", "left").withColumn("cluster", F.coalesce("__c", "id")).drop("__c")


def merge_clusters(clustered: DataFrame) -> DataFrame:
    """One row per cluster.

    The first row by (ts, source, source_id) gives time and place; flags hold if any row
    has them; severity is the gravest; reports are the first that are not null; n_sources
    counts different sources and sources lists them, sorted, joined by ';'.
    """
    order = F.struct("ts", "source", "source_id")
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    first = lambda c: F.min_by(c, order)
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    return clustered.groupBy("cluster").agg(
        *[first(c).alias(c) for c in ("source", "source_id", "ts", "x", "y")],
        F.bool_or("is_ped").alias("is_ped"), F.bool_or("is_bike").alias("is_bike"),
        F.min_by("severity", F.when(rank > 0, rank)).alias("severity"),
        known("light_report").alias("light_report"), known("surface_report").alias("surface_report"),
        F.countDistinct("source").alias("n_sources"), F.concat_ws(";", F.array_sort(F.collect_set("source"))).alias("sources"), F.count("*").alias("n_rows"),
    )


def numeric_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns all of whose non-null values read as numbers, found in one pass."""
    ok = df.agg(*[(F.count(F.col(c)) == F.count(F.col(c).cast("string").try_cast("double"))).alias(c) for c in columns]).first()
    return [c for c in columns if ok[c]]


def local_positions(df: DataFrame) -> DataFrame:
    """`df` with x and y: metres from the mean position of its rows."""
    mean = df.agg(F.avg("lat").alias("__lat0"), F.avg("lon").alias("__lon0"))
    x, y = geo.local_xy(F.col("lat"), F.col("lon"), F.col("__lat0"), F.col("__lon0"))
    return df.join(F.broadcast(mean)).withColumns({"x": x, "y": y}).drop("__lat0", "__lon0")
