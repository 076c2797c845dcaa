"""Order-based operators over a whole table, without one task that sees all rows.

`Window.orderBy` without a partition sends the table to a single task. Here rows are dealt
by range, a window runs within each range, and each range adds what the ones before it
hold. Only one row per range is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meridian.plans.scratch import Scratch


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` with part: the number of the range, in `order`, that a row fell into. Written once, so that later reads agree."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Scratch(df.sparkSession).write(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], rank: str | None = None, inclusive: bool = False) -> DataFrame:
    """`df` with running sums of the columns in `sums`, in `order`, and `rank`, the row number from 1.

    Without `inclusive` a row's own value is not in its sum. `order` must be total for the
    result to be unique. Null values add nothing. An empty table gives an empty result.
    """
    values = {f"__v{i}": c for i, c in enumerate(sums.values())}
    held = ranged(df.withColumns(values), order)
    totals = held.groupBy("part").agg(F.count("*").alias("__n"), *[F.sum(v).alias(f"__t{v}") for v in values])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in totals.columns[1:]])
    own = Window.partitionBy("part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = held.join(F.broadcast(offsets), "part")
    cols = {name: F.coalesce(F.sum(v).over(upto), F.lit(0)) + F.col(f"__t{v}") for name, v in zip(sums, values)}
    if rank:
        cols[rank] = F.row_number().over(own) + F.col("__n")
    return out.withColumns(cols).select(*df.columns, *cols)


def row_numbers(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """`df` with a gapless row number from 1 in `order`."""
    return running(df, order, {}, rank)


def running_within(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], rank: str | None = None) -> DataFrame:
    """`df` with running sums of whole numbers within each `key`, in `order`, own value included, and `rank`, from 1 in each key.

    A key may hold any share of the rows: it lies in as many ranges as it fills, and each
    range adds what the one before it holds of the same key. `key` has no nulls. `order`
    must be total within a key for the result to be unique. An empty table gives an empty result.
    """
    values = {f"__v{i}": c for i, c in enumerate(sums.values())} | {"__one": F.lit(1)}
    held = ranged(df.withColumns(values), [F.col(key), *order])
    ends = held.groupBy("part").agg(F.min(key).alias("__first"), F.max(key).alias("__last"))
    last = F.broadcast(ends.select("part", F.col("__last").alias(key)))  # one row per range
    tails = held.join(last, ["part", key]).groupBy("part").agg(*[F.sum(v).alias(v) for v in values])
    of_key, by_part = Window.partitionBy("__last").orderBy("part"), Window.orderBy("part")
    held_so_far = ends.join(tails, "part").withColumns({v: F.sum(v).over(of_key) for v in values})
    same = F.lag("__last").over(by_part) == F.col("__first")
    carried = held_so_far.select("part", "__first", *[F.when(same, F.lag(v).over(by_part)).otherwise(0).alias(f"__c{v}") for v in values])
    out = held.join(F.broadcast(carried), "part")
    own = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = dict(zip([*sums, rank or "__r"], values))
    cols = {name: F.sum(v).over(own) + F.when(F.col(key) == F.col("__first"), F.col(f"__c{v}")).otherwise(0) for name, v in names.items()}
    return out.withColumns(cols).select(*df.columns, *[c for c in cols if c != "__r"])


def previous(df: DataFrame, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """`df` with, under new names, the columns of the row before it in `order`; null in the first row."""
    held = ranged(df, order)
    own = Window.partitionBy("part").orderBy(*order)
    numbered = held.withColumns({"__r": F.row_number().over(own), "__n": F.count("*").over(Window.partitionBy("part"))})
    ends = numbered.where("__r = __n").select("part", F.struct(*columns).alias("end"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = ends.select("part", F.last("end").over(every).alias("__end"))
    out = held.join(F.broadcast(carried), "part", "left").withColumn("__first", F.row_number().over(own) == 1)
    new = {name: F.when(F.col("__first"), F.col("__end")[c]).otherwise(F.lag(c).over(own)) for c, name in columns.items()}
    return out.withColumns(new).select(*df.columns, *new)


def deciles(df: DataFrame, order: list[Column], bins: int = 10, name: str = "decile") -> DataFrame:
    """`df` with equal-width cuts of its ranks: rank r of n falls in bin max(0, ceil(bins * (r - 1) / (n - 1)) - 1)."""
    ranked = row_numbers(df, order, "__r")
    n = df.agg(F.count("*").alias("__n"))
    r = (F.col("__r") - 1).cast("double")
    cut = F.greatest(F.lit(0), F.ceil(bins * r / F.greatest(F.col("__n") - 1, F.lit(1))) - 1)
    return ranked.join(F.broadcast(n)).withColumn(name, cut.cast("int")).select(*df.columns, name)


def average_ranks(df: DataFrame, value: str, rank: str = "rank") -> DataFrame:
    """`df` with the mean row number of its equals by ascending `value`."""
    counts = df.groupBy(value).agg(F.count("*").alias("__c"))
    below = running(counts, [F.col(value)], {"__b": F.col("__c")})
    place = below.select(value, (F.col("__b") + (F.col("__c") + 1) / 2).alias(rank))
    return df.join(place, value)


def even_quantiles(df: DataFrame, value: str, points: int, by: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(by, i, q): `points` exact quantiles of `value`, evenly spaced and interpolated, for each group of `by` or for all rows.

    Values are counted, and the running counts tell which values stand at the places that a
    quantile lies between, so no task holds a group or the table. Nulls do not count; a group
    without values has no row. With `times` a row counts that often.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg((F.sum(times) if times else F.count("*")).alias("__c"))
    below = running(counts, [*[F.col(c) for c in by], F.col("__v")], {"__b": F.col("__c")})
    total = below.groupBy(*by).agg(F.min("__b").alias("__start"), F.sum("__c").alias("__n"))
    rows = below.join(total, by) if by else below.join(F.broadcast(total))
    first, last, steps = F.col("__b") - F.col("__start"), F.col("__b") - F.col("__start") + F.col("__c") - 1, points - 1
    width = F.greatest(F.col("__n") - 1, F.lit(1))
    near = F.sequence(F.greatest(F.lit(0), F.floor((first - 1) * steps / width).cast("int")), F.least(F.lit(steps), F.ceil((last + 1) * steps / width).cast("int") + 1))
    at = rows.select(*by, "__v", first.alias("__f"), last.alias("__l"), "__n", F.explode(near).alias("i"))
    at = at.withColumn("__p", F.col("i") / steps * (F.col("__n") - 1))
    low, high = F.floor("__p").between(F.col("__f"), F.col("__l")), F.ceil("__p").between(F.col("__f"), F.col("__l"))
    found = at.where(low | high).groupBy(*by, "i").agg(F.max(F.when(low, F.col("__v"))).alias("a"), F.max(F.when(high, F.col("__v"))).alias("b"), F.first("__p").alias("p"))
    between = (F.ceil("p") - F.col("p")) * F.col("a") + (F.col("p") - F.floor("p")) * F.col("b")
    return found.select(*by, "i", F.when((F.col("a") == F.col("b")) | (F.floor("p") == F.ceil("p")), F.col("a")).otherwise(between).alias("q"))
