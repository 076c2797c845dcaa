"""Routines in travel logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from meridian.functions import geo, times
from meridian.operators.safety import thin_points

# Metres and scores of the suggestions.
PLACE_M, NEAR_M, FAR_M, HERE_M = 150.0, 300.0, 1500.0, 200.0
NEAR_BOOST, FAR_FACTOR = 3.0, 0.25
MIN_TRIPS, MIN_SCORE, RETURN_SCORE = 2, 0.15, 2.0
LOG = 200


def last_trips(trips: DataFrame, user: str = "user", most: int = LOG) -> DataFrame:
    """The newest `most` trips of each user."""
    w = Window.partitionBy(user).orderBy(F.desc("at"), F.desc("trip"))
    return trips.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def place_clusters(trips: DataFrame) -> DataFrame:
    """`trips` (user, trip, at, x1, y1, x2, y2) with start and end: numbers of places, newest first.

    Points within 150 m of a place's newest point are that place. A user's log is cut to
    `LOG` trips first, so a group is of bounded size.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["at", "trip"], ascending=False, kind="stable").reset_index(drop=True)
        anchors: list[tuple[float, float]] = []

        def place(x: float, y: float) -> int:
            for k, (u, v) in enumerate(anchors):
                if (u - x) ** 2 + (v - y) ** 2 <= PLACE_M**2:
                    return k
            anchors.append((x, y))
            return len(anchors) - 1

        ends = [(place(x2, y2), place(x1, y1)) for x1, y1, x2, y2 in zip(g["x1"], g["y1"], g["x2"], g["y2"])]
        return pd.DataFrame({"trip": g["trip"], "end": [e for e, _ in ends], "start": [s for _, s in ends]})

    log = last_trips(trips).select("user", "trip", "at", "x1", "y1", "x2", "y2")
    return log.join(log.groupBy("user").applyInPandas(run, "trip long, end int, start int"), "trip")


def routines(clustered: DataFrame, now: Column, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """(user, start, end, trips, score): pairs of places a user tends to go between at this time.

    Each trip weighs by its hour and weekday against now and by its age; pairs need two
    trips and 0.15. With a position, starting points near it count three times, far ones a
    quarter.
    """
    clock = lambda t: F.hour(t) + F.minute(t) / 60.0
    age = (F.unix_timestamp(now) - F.unix_timestamp("at")) / 86_400.0
    close = times.hour_similarity(clock(F.col("at")), clock(now))
    weight = close * times.day_similarity(F.weekday("at"), F.weekday(now)) * times.decay(age)
    used = clustered.where("start <> end").withColumns({"__c": close, "__w": weight}).where("__c > 0")
    newest = lambda c: F.max_by(c, F.struct("at", "trip"))
    pairs = used.groupBy("user", "start", "end").agg(F.count("*").alias("trips"), F.sum("__w").alias("score"), newest("x1").alias("x"), newest("y1").alias("y"))
    pairs = pairs.where((F.col("trips") >= MIN_TRIPS) & (F.col("score") >= MIN_SCORE))
    if x is not None:
        away = F.hypot(F.col("x") - x, F.col("y") - y)
        pairs = pairs.withColumn("score", F.col("score") * F.when(away <= NEAR_M, NEAR_BOOST).when(away > FAR_M, FAR_FACTOR).otherwise(1.0))
    return pairs.select("user", "start", "end", "trips", "score")


def returns(trips: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """(user, trip, score): each user's last trip by now, if it is at most `hours` old: they may be heading back."""
    past = trips.where(F.col("at") <= now).groupBy("user").agg(F.max(F.struct("at", "trip")).alias("m"))
    fresh = F.unix_timestamp(now) - F.unix_timestamp("m.at") <= hours * 3600
    return past.where(fresh).select("user", F.col("m.trip").alias("trip"), F.lit(RETURN_SCORE).alias("score"))


def ranked_suggestions(candidates: DataFrame, limit: int, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """The best `limit` of each user's `candidates` (user, id, score, x, y: where they lead), and their rank from 1.

    By falling score, equals by id, a candidate that leads within 150 m of a better one that stays goes, of whatever kind either is. With the user's own position,
    those that lead within 200 m of it go first. Candidates without a score come last; a null position is near nothing.
    """
    far = candidates
    if x is not None:
        far = far.where(F.coalesce(F.hypot(F.col("x") - x, F.col("y") - y) > HERE_M, F.lit(True)))
    best = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("s"), F.col("id").alias("i"))
    thin = thin_points(far, PLACE_M, ["user"], best)
    w = Window.partitionBy("user").orderBy(best)
    return thin.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def walk_minutes(metres: Column, speed: float = 1.3, detour: float = 1.3) -> Column:
    """Whole minutes of a walk as the crow flies with detours, at least one."""
    return F.greatest(F.lit(1), F.floor(metres * detour / speed / 60 + 0.5)).cast("int")


def rail_handoffs(walks: DataFrame, stations: DataFrame, least_s: float = 25 * 60.0) -> DataFrame:
    """(id, board, alight) of walks (id, x1, y1, x2, y2, duration) over 25 minutes that rail can shorten.

    Stations must differ, and the walks to and from them together must be shorter than the trip.
    """
    from meridian.operators.spatial import nearest

    long = walks.where(F.col("duration") > least_s)
    board = nearest(long.select("id", F.col("x1").alias("x"), F.col("y1").alias("y")), stations, 1000.0).toDF("id", "board", "d1")
    alight = nearest(long.select("id", F.col("x2").alias("x"), F.col("y2").alias("y")), stations, 1000.0).toDF("id", "alight", "d2")
    both = long.select("id", "duration").join(board, "id").join(alight, "id").where("board <> alight")
    return both.where((walk_minutes(F.col("d1")) + walk_minutes(F.col("d2"))) * 60 < F.col("duration")).select("id", "board", "alight")


def remaining(path: Column, along: Column, duration: Column) -> Column:
    """Seconds left of a trip whose path has been followed for `along` metres."""
    total = geo.path_length(path)
    return F.when(total > 0, F.greatest(F.lit(0.0), duration * (1 - along / total))).otherwise(0.0)
