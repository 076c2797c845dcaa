"""Counts over time and space: hourly rollups, profiles, dense cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meridian.functions import times
from meridian.operators.ranking import even_quantiles, previous


def hourly_rollup(events: DataFrame, key: str, weight: Column, flags: dict[str, Column]) -> DataFrame:
    """(bucket, key, total, one sum per flag): weights by hour and key; a flag's sum takes the rows where it holds."""
    sums = [F.sum(weight).alias("total"), *[F.sum(F.when(c, weight).otherwise(0)).alias(n) for n, c in flags.items()]]
    return events.where("ts is not null").groupBy(F.date_trunc("hour", "ts").alias("bucket"), key).agg(*sums)


def hour_profile(rollup: DataFrame, value: str, zone: str | None = None) -> DataFrame:
    """(hour, value): a rollup by the hour of the day, in `zone` or the session's."""
    at = F.from_utc_timestamp("bucket", zone) if zone else F.col("bucket")
    return rollup.groupBy(F.hour(at).alias("hour")).agg(F.sum(value).alias(value))


def dense_profile(rollup: DataFrame, key: str, value: str) -> DataFrame:
    """(key, profile): 24 values per key in order of the hour, 0 where nothing happened."""
    by_hour = rollup.groupBy(key, F.hour("bucket").alias("hour")).agg(F.sum(value).cast("double").alias("v"))
    known = F.map_from_entries(F.collect_list(F.struct("hour", "v")))  # 24 entries at most
    return by_hour.groupBy(key).agg(known.alias("m")).select(
        key, F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at("m", h), F.lit(0.0))).alias("profile")
    )


def aligned(keys: DataFrame, counts: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Every key with its values, 0 where it has none."""
    return keys.join(counts, on, "left").fillna(0, values)


def window_counts(events: DataFrame, keys: DataFrame, key: str, years: tuple[int, int], weight: Column, flag: Column | None = None) -> DataFrame:
    """(key, total): weights of the events in a span of years, both ends in, where `flag` holds; all keys are there."""
    chosen = events.where(F.col("year").between(*years))
    if flag is not None:
        chosen = chosen.where(F.coalesce(flag, F.lit(False)))
    return aligned(keys.select(key), chosen.groupBy(key).agg(F.sum(weight).alias("total")), [key], ["total"])


def wet_hours(hours: DataFrame, threshold: float = 0.1) -> DataFrame:
    """`hours` (time, precip) with wet: rain of `threshold` now or in the row before; null is no rain."""
    now = hours.withColumn("__now", F.coalesce(F.col("precip"), F.lit(0.0)) >= threshold)
    got = previous(now, [F.col("time")], {"__now": "__before"})
    return got.withColumn("wet", F.col("__now") | F.coalesce("__before", F.lit(False))).drop("__now", "__before")


def exposure_cells(hours: DataFrame) -> DataFrame:
    """(day_group, hour, light, wet, hours): how often each kind of hour occurred; light at half past."""
    middle = F.col("time") + F.expr("interval 30 minutes")
    cells = hours.select(times.day_group(F.col("time")).alias("day_group"), F.hour("time").alias("hour"), times.light(middle).alias("light"), "wet")
    return cells.groupBy("day_group", "hour", "light", "wet").agg(F.count("*").alias("hours"))


def cell_table(events: DataFrame, cells: DataFrame, groups: DataFrame, dims: list[str], group: str, flag: str) -> DataFrame:
    """Every cell x group x flag with its count and hours, 0 where nothing happened.

    `cells` has the columns `dims` and hours, `groups` the values of `group`; both are small
    by construction (hours of the week by conditions, a handful of groups). The rows with
    flag false hold the other events, not all of them.
    """
    flags = F.explode(F.array(F.lit(False), F.lit(True))).alias(flag)
    grid = cells.crossJoin(F.broadcast(groups)).select("*", flags)  # fixed sets of categories
    counts = events.groupBy(*dims, group, flag).agg(F.count("*").alias("count"))
    return aligned(grid, counts, [*dims, group, flag], ["count"])


def flat_rates(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate): count over hours of whole groups."""
    return table.groupBy(*by).agg((F.sum("count") / F.sum("hours")).alias("rate"))


def collapse(table: DataFrame, keep: list[str]) -> DataFrame:
    """A cell table summed over all dimensions but `keep`."""
    return table.groupBy(*keep).agg(F.sum("count").alias("count"), F.sum("hours").alias("hours"))


def fill_group_median(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """`df` with nulls of `columns` filled by their group's exact median, then by 0. A null group has no median."""
    out = df
    for c in columns:
        medians = even_quantiles(df.where(F.col(group).isNotNull()), c, 3, [group]).where("i = 1")
        out = out.join(medians.select(group, F.col("q").alias(f"__{c}")), group, "left").select(*out.columns, f"__{c}")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}"), F.lit(0.0)) for c in columns}).drop(*[f"__{c}" for c in columns])


def crosstab(df: DataFrame, keys: DataFrame, key: str, by: str, values: list[str]) -> DataFrame:
    """All keys x the given values of `by` as columns of counts."""
    return aligned(keys.select(key), df.groupBy(key).pivot(by, values).count(), [key], values)


def day_part_rates(volumes: DataFrame, periods: dict[str, tuple[int, int]]) -> DataFrame:
    """`volumes` with the mean hourly rate of each day part, from daily volumes of periods of hours.

    An hour takes its period's volume over the period's length. Hours of a null period are
    left out; a day part without a known hour is null.
    """
    out = {}
    for part, hours in times.DAY_PARTS.items():
        met = [(c, b - a, len(set(hours) & set(range(a, b)))) for c, (a, b) in periods.items()]
        known = [m for m in met if m[2]]  # a period's rate times its hours, not the rate added hour by hour, which adds up its rounding
        total = sum((F.coalesce(F.col(c) / n * shared, F.lit(0.0)) for c, n, shared in known), F.lit(0.0))
        count = sum((F.when(F.col(c).isNotNull(), shared).otherwise(0) for c, _, shared in known), F.lit(0))
        out[part] = F.when(count > 0, total / count)
    return volumes.withColumns(out)


def known_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the columns that are not null; null if all are."""
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def share_with_evidence(df: DataFrame, key: str, length: str, state: str, least: float = 0.5) -> DataFrame:
    """(key, share): length in state 1 over length in a known state (0 or 1); null unless `least` of all length is known."""
    known = F.sum(F.when(F.col(state) >= 0, F.col(length)).otherwise(0.0))
    yes = F.sum(F.when(F.col(state) == 1, F.col(length)).otherwise(0.0))
    return df.groupBy(key).agg(F.when((known > 0) & (known >= least * F.sum(length)), yes / known).alias("share"))


def histogram_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the smallest value up to which at least half of a key's rows lie."""
    bins = df.groupBy(key, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(key).orderBy(value)
    total = Window.partitionBy(key)
    half = bins.withColumns({"c": F.sum("n").over(upto), "t": F.sum("n").over(total)}).where("2 * c >= t")
    return half.groupBy(key).agg(F.min(value).alias("median"))


def trailing_days(df: DataFrame, day: str, end: Column, days: int) -> DataFrame:
    """Rows whose date lies in (end - days, end]."""
    return df.where((F.col(day) > F.date_sub(end, days)) & (F.col(day) <= end))


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """`df` with a number per run within `keys`: it goes up where `new` holds. Runs stay within a key, so a key's rows share a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__new", new).withColumn(name, F.sum(F.coalesce(F.col("__new").cast("int"), F.lit(1))).over(w)).drop("__new")


def merge_alerts(steps: DataFrame, path: str, score: int = 90, gap: float = 100.0) -> DataFrame:
    """Warnings along paths: (path, start, end, names, score, stretches).

    `steps` has path, pos, name, length and score. Steps of at least `score` that follow each
    other on one street are a stretch; stretches at most `gap` metres apart are one warning
    with its names in order, each once, and the highest score.
    """
    along = Window.partitionBy(path).orderBy("pos")
    s = steps.withColumn("start", F.coalesce(F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumns({"end": F.col("start") + F.col("length"), "prev": F.lag(F.struct("name", "score")).over(along)})
    high = islands(s.where(F.col("score") >= score), [path], ["pos"], ~((F.col("prev.name") == F.col("name")) & (F.col("prev.score") >= score)), "run")
    runs = high.groupBy(path, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.first("name").alias("name"))
    before = F.lag("end").over(Window.partitionBy(path).orderBy("start"))
    far = islands(runs.withColumn("before", before), [path], ["start"], F.col("start") - F.col("before") > gap, "alert")
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: x["name"]))
    return far.groupBy(path, "alert").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), names.alias("names"), F.max("score").alias("score"), F.count("*").alias("stretches")
    )
