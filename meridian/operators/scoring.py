"""Scores, bands and their exact explanation."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from meridian.operators.ranking import even_quantiles


def quantile_table(df: DataFrame, value: str, points: int = 1001, times: str | None = None) -> DataFrame:
    """(q): `points` exact quantiles, evenly spaced, with linear interpolation; null without values. With `times` a row counts that often."""
    listed = even_quantiles(df, value, points, times=times).agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("l"))  # one entry per point
    return listed.select(F.when(F.size("l") > 0, F.col("l.q")).alias("q"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def percentile_score(value: Column, q: Column) -> Column:
    """Place of a value on a quantile table, 0 to 100, linear between entries and clamped.

    The table is one array of fixed size; a binary search over it runs inside the expression.
    """
    n = F.size(q)
    middle = lambda s: F.shiftright(s["a"] + s["b"], 1)

    def search(v: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            return let(middle(s), lambda m: F.when(s["b"] - s["a"] <= 1, s).when(F.get(q, m) <= v, F.struct(m.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), m.alias("b"))))

        steps = F.sequence(F.lit(1), F.lit(11))  # 2^11 > 1001 entries
        return F.aggregate(steps, F.struct(F.lit(0).alias("a"), (n - 1).alias("b")), halve)["a"]

    def place(v: Column) -> Column:
        def between(lo: Column) -> Column:
            a, b = F.get(q, lo), F.get(q, lo + 1)
            return (lo + F.when(b == a, 0.0).otherwise((v - a) / (b - a))) * 100 / (n - 1)

        return F.when(v <= F.get(q, F.lit(0)), 0.0).when(v >= F.get(q, n - 1), 100.0).otherwise(let(search(v), between))

    return let(value, place)


def centered_factors(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with each factor less its mean, and base, the sum of the means."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    out = df.join(F.broadcast(means)).withColumn("base", sum((F.col(f"__{c}") for c in columns), F.lit(0.0)))
    return out.withColumns({c: F.col(c) - F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def attribute(base: Column, factors: dict[str, Column], q: Column, top: int = 5) -> Column:
    """Struct (baseline, factors, remainder, score): whole points that add up to the score.

    Factors are taken by size, largest first (equal ones by name), and each gets the change of
    the score it makes on top of those before. All but the `top` go into the remainder, which
    also takes what rounding leaves.
    """
    items = F.array(*[F.struct((-F.abs(c)).alias("k"), F.lit(n).alias("name"), c.alias("v")) for n, c in sorted(factors.items())])
    start = F.struct(base.alias("at"), percentile_score(base, q).alias("score"), F.expr("cast(array() as array<struct<name:string,points:double>>)").alias("done"))

    def step(acc: Column, f: Column) -> Column:
        def moved(score: Column) -> Column:
            told = F.struct(f["name"].alias("name"), (score - acc["score"]).alias("points"))
            return F.struct((acc["at"] + f["v"]).alias("at"), score.alias("score"), F.concat(acc["done"], F.array(told)).alias("done"))

        return let(percentile_score(acc["at"] + f["v"], q), moved)

    def told(walked: Column) -> Column:
        shown = F.transform(F.slice(walked["done"], 1, top), lambda x: F.struct(x["name"].alias("name"), F.rint(x["points"]).cast("int").alias("points")))
        return F.struct(F.rint(walked["score"]).cast("int").alias("score"), shown.alias("shown"))

    def whole(end: Column) -> Column:
        def added(baseline: Column) -> Column:
            spent = F.aggregate(end["shown"], F.lit(0), lambda n, x: n + x["points"])
            return F.struct(baseline.alias("baseline"), end["shown"].alias("factors"), (end["score"] - baseline - spent).alias("remainder"), end["score"].alias("score"))

        return let(F.rint(percentile_score(base, q)).cast("int"), added)

    return let(let(F.aggregate(F.array_sort(items), start, step), told), whole)


def hotspots(nodes: DataFrame, score: str, share: float = 0.05, floor: int = 75) -> DataFrame:
    """The nodes at or above the score at place ceil(share * n) from the top, or `floor` if that is higher; ties stay."""
    counts = nodes.groupBy(score).agg(F.count("*").alias("c"))
    w = Window.orderBy(F.desc(score))  # one row per whole score from 0 to 100
    total = nodes.agg(F.greatest(F.ceil(F.count("*") * share), F.lit(1)).alias("k"))
    bar = counts.withColumn("upto", F.sum("c").over(w)).join(F.broadcast(total)).where("upto >= k").agg(F.max(score).alias("bar"))
    return nodes.join(F.broadcast(bar)).where(F.col(score) >= F.greatest(F.coalesce("bar", F.lit(floor)), F.lit(floor))).drop("bar")


def tercile_bands(df: DataFrame, columns: list[str], names: tuple[str, str, str] = ("quiet", "moderate", "busy")) -> DataFrame:
    """`df` with <column>_band from the exact thirds of all values of all columns; null is unknown."""
    pooled = df.select(F.explode(F.array(*columns)).alias("v")).where("v is not null")
    cut = even_quantiles(pooled, "v", 4).where("i in (1, 2)").agg(F.array_sort(F.collect_list(F.struct("i", "q")))["q"].alias("t"))
    out = df.join(F.broadcast(cut))
    band = lambda c: F.when(F.col(c).isNull(), "unknown").when(F.col(c) <= F.col("t")[0], names[0]).when(F.col(c) <= F.col("t")[1], names[1]).otherwise(names[2])
    return out.withColumns({f"{c}_band": band(c) for c in columns}).drop("t")


def gamma_below(shape: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1.0 / shape
        k = shape
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    tiny = 1e-300
    b = x + 1 - shape
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h)


def rate_bands(df: DataFrame, count: str, exposure: str, sure: float = 0.9) -> DataFrame:
    """`df` with band: higher or lower than the mean rate with posterior chance `sure`, else typical.

    A gamma prior is fitted by moments; without variance beyond chance all are at the
    mean. higher also needs a count. If nothing was counted all are typical. A null or
    non-positive exposure is typical.
    """
    sound = F.col(exposure) > 0
    totals = df.where(sound).agg(F.sum(count).alias("y"), F.sum(exposure).alias("e"), F.sum(F.pow(exposure, 2)).alias("e2"), F.count("*").alias("n")).first()
    if not totals["y"]:
        return df.withColumn("band", F.lit("typical"))
    mean = totals["y"] / totals["e"]
    spread = df.where(sound).agg(F.sum(F.pow(F.col(count) - F.col(exposure) * mean, 2)).alias("s")).first()["s"]
    variance = (spread - totals["y"]) / totals["e2"]
    alpha = mean * mean / variance if variance > 0 else 1e9
    beta = alpha / mean

    @F.pandas_udf("string")
    def band(y: pd.Series, e: pd.Series) -> pd.Series:
        known = {}
        for a, b in set(zip(y, e)):  # counts and exposures recur
            below = gamma_below(alpha + a, (beta + b) * mean) if b > 0 else 0.5
            known[a, b] = "typical" if not b > 0 else "higher" if a > 0 and 1 - below >= sure else "lower" if below >= sure else "typical"
        return pd.Series([known.get(k, "typical") for k in zip(y, e)], dtype=object)

    return df.withColumn("band", band(F.col(count).cast("double"), F.col(exposure).cast("double")))


def log_mean_exp(value: Column, weight: Column) -> Column:
    """Aggregate: log of the weighted mean of exp(value)."""
    return F.ln(F.sum(F.exp(value) * weight) / F.sum(weight))


def frames(grid: DataFrame, key: str, value: str) -> DataFrame:
    """(key, scores): 24 whole scores, by hour, as bytes would hold them (0 to 100, halves to even)."""
    whole = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(value))).cast("short")
    return grid.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", whole.alias("s")))), lambda x: x["s"]).alias("scores"))


def unpack_frames(packed: DataFrame, key: str) -> DataFrame:
    """(key, hour, score) from packed frames."""
    return packed.select(key, F.posexplode("scores").alias("hour", "score"))
