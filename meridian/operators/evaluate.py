"""Honest evaluation of rankings and count models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from meridian.operators.ranking import average_ranks, deciles, ranged, running
from meridian.plans.scratch import Scratch

#: Blocks or groups that may go through the driver.
MOST_AREAS = 100_000
#: Rows of draws of blocks that are broadcast, at most.
MOST_DRAWS = 2_000_000


def overdispersion(df: DataFrame, y: str, mu: str) -> DataFrame:
    """(k): method of moments, max(0, sum((y - mu)^2 - y) / sum(mu^2)); 0 without any mu."""
    num = F.sum(F.pow(F.col(y) - F.col(mu), 2) - F.col(y))
    return df.agg(F.greatest(F.lit(0.0), F.coalesce(num / F.nullif(F.sum(F.pow(mu, 2)), F.lit(0.0)), F.lit(0.0))).alias("k"))


def shrunk(y: Column, mu: Column, k: Column) -> Column:
    """Empirical Bayes: w * mu + (1 - w) * y with w = 1 / (1 + k * mu)."""
    w = 1 / (1 + k * mu)
    return w * mu + (1 - w) * y


def deviance(y: Column, mu: Column) -> Column:
    """Aggregate: twice the mean of y ln(y / mu) - (y - mu), with 0 ln 0 = 0 and mu at least 1e-12."""
    m = F.greatest(mu, F.lit(1e-12))
    return 2 * F.avg(F.when(y > 0, y * F.ln(y / m)).otherwise(0.0) - (y - m))


def best_k(df: DataFrame, y: str, mu: str, target: str, grid: list[float]) -> DataFrame:
    """(k, deviance): the k of the grid whose shrunk (y, mu) forecast `target` best; the first of equals."""
    tried = df.select(y, mu, target, F.posexplode(F.array(*map(F.lit, grid))).alias("i", "k"))
    fit = tried.groupBy("i", "k").agg(deviance(F.col(target), shrunk(F.col(y), F.col(mu), F.col("k"))).alias("deviance"))
    return fit.agg(F.min(F.struct("deviance", "i", "k")).alias("m")).select("m.k", "m.deviance")


def capture(df: DataFrame, score: str, observed: str, length: str, tie: str, share: float = 0.1) -> DataFrame:
    """(captured, observed, share): what of `observed` lies in the top `share` of the length.

    Rows are taken by score, highest first (equal ones by `tie`); the one across the line
    counts in proportion. The share is null if nothing was observed.
    """
    ranked = running(df, [F.desc(score), F.asc(tie)], {"before": F.col(length)})
    budget = F.broadcast(df.agg((F.sum(length) * share).alias("budget")))
    take = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("budget") - F.col("before")) / F.col(length)))
    got = ranked.join(budget).agg(F.sum(take * F.col(observed)).alias("captured"), F.sum(observed).alias("observed"))
    return got.withColumn("share", F.col("captured") / F.nullif(F.col("observed"), F.lit(0)))


def calibration(df: DataFrame, predicted: str, observed: str, tie: str) -> DataFrame:
    """(decile, predicted, observed, ratio) by tenths of the predictions' ranks."""
    cut = deciles(df, [F.asc(predicted), F.asc(tie)])
    out = cut.groupBy("decile").agg(F.sum(predicted).alias("predicted"), F.sum(observed).alias("observed"))
    return out.withColumn("ratio", F.col("observed") / F.nullif(F.col("predicted"), F.lit(0.0)))


def auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """(auc): chance that a positive ranks above a negative, ties counting half; null with one class only."""
    ranked = average_ranks(df.select(F.col(score).alias("s"), label.cast("long").alias("l")), "s")
    sums = ranked.agg(F.sum(F.col("rank") * F.col("l")).alias("r"), F.sum("l").alias("p"), F.count("*").alias("n"))
    pairs = F.col("p") * (F.col("n") - F.col("p"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(pairs, F.lit(0))).alias("auc"))


def average_precision(df: DataFrame, score: str, label: Column) -> DataFrame:
    """(ap): sum over thresholds of the recall gained times the precision there; null without a positive."""
    steps = df.groupBy(F.col(score).alias("s")).agg(F.sum(label.cast("long")).alias("p"), F.count("*").alias("n"))
    upto = running(steps, [F.desc("s")], {"tp": F.col("p"), "seen": F.col("n")}, inclusive=True)
    return upto.agg((F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.nullif(F.sum("p"), F.lit(0))).alias("ap"))


def shape_deviance(df: DataFrame, predicted: str, observed: str) -> DataFrame:
    """(deviance) of the predictions scaled to the observed total."""
    scale = df.agg((F.sum(observed) / F.nullif(F.sum(predicted), F.lit(0.0))).alias("f"))
    return df.join(F.broadcast(scale)).agg(deviance(F.col(observed), F.col(predicted) * F.col("f")).alias("deviance"))


def block_draws(blocks: list, reps: int, seed: int) -> pd.DataFrame:
    """(rep, block, times): how often each block comes up when as many are drawn with replacement."""
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(reps):
        picked, times = np.unique(rng.integers(0, len(blocks), len(blocks)), return_counts=True)
        rows += [(r, blocks[b], int(t)) for b, t in zip(picked, times)]
    return pd.DataFrame(rows, columns=["rep", "block", "times"])


def _areas(df: DataFrame, column: str) -> list:
    """The different values of a column of areas, in order; more than MOST_AREAS are an error, as they go through the driver."""
    found = [r[0] for r in df.select(column).distinct().limit(MOST_AREAS + 1).collect()]
    if len(found) > MOST_AREAS:
        raise ValueError(f"{column} has over {MOST_AREAS} values; take larger areas")
    return sorted(found)


def resampled_captures(
    df: DataFrame, scores: list[str], observed: str, length: str, block: str, tie: str, reps: int = 200, share: float = 0.1, seed: int = 0, draws: DataFrame | None = None
) -> DataFrame:
    """(method, rep, c): each score's capture in each resampling of the blocks; null in one without an observation.

    A draw changes what a row weighs and not its place, so rows are dealt by range of the score
    once, and the sums of a range by block tell how much a draw has of it. Ranges above the
    line of a draw count whole; rows are looked at only in the one range that it crosses, as
    that many copies of each. `draws` (rep, block, times) are made from `seed` if not given.
    """
    spark = df.sparkSession
    if draws is None:
        areas = _areas(df, block)
        if len(areas) * reps > MOST_DRAWS:
            raise ValueError(f"{len(areas)} values of {block} times {reps} draws are over {MOST_DRAWS}; take larger areas, fewer draws, or block_interval")
        draws = spark.createDataFrame(block_draws(areas, reps, seed)).withColumnRenamed("block", block)
    elif draws.limit(MOST_DRAWS + 1).count() > MOST_DRAWS:
        raise ValueError(f"over {MOST_DRAWS} draws; take larger areas or fewer draws")
    draws, out = F.broadcast(draws), None
    for score in scores:
        held = ranged(df.select(block, tie, observed, length, F.col(score).cast("double").alias("s")), [F.desc("s"), F.asc(tie)])
        sums = held.groupBy("part", block).agg(F.sum(length).alias("l"), F.sum(observed).alias("o")).join(draws, block)
        parts = sums.groupBy("rep", "part").agg(F.sum(F.col("l") * F.col("times")).alias("held"), F.sum(F.col("o") * F.col("times")).alias("got"))
        rep = Window.partitionBy("rep")  # one row per range
        before = rep.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumns({"offset": F.coalesce(F.sum("held").over(before), F.lit(0.0)), "budget": F.sum("held").over(rep) * share})
        parts = Scratch(spark).write(parts.withColumn("inside", F.col("offset") + F.col("held") <= F.col("budget")))
        whole = parts.groupBy("rep").agg(F.sum("got").alias("all"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("got"))), F.lit(0)).alias("whole"))
        line = F.broadcast(parts.where("not inside and offset < budget").select("rep", "part", "offset", "budget"))  # one range per draw
        own = Window.partitionBy("rep").orderBy(F.desc("s"), tie).rowsBetween(Window.unboundedPreceding, -1)
        rows = held.join(line, "part").join(draws, ["rep", block]).withColumn("size", F.col(length) * F.col("times"))
        rows = rows.withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(own), F.lit(0.0)))
        take = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("budget") - F.col("before")) / F.col("size")))
        some = rows.groupBy("rep").agg(F.sum(take * F.col(observed) * F.col("times")).alias("some"))
        c = (F.col("whole") + F.coalesce("some", F.lit(0.0))) / F.nullif(F.col("all").cast("double"), F.lit(0.0))
        one = whole.join(some, "rep", "left").select(F.lit(score).alias("method"), "rep", c.alias("c"))
        out = one if out is None else out.unionByName(one)
    return out


def _interval(draws: DataFrame, by: list[str], value: str, level: float) -> DataFrame:
    """(by, low, high): percentile interval over the draws, a fixed number for each of `by`; nulls do not count."""
    tail = (1 - level) / 2
    q = draws.groupBy(*by).agg(F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return q.select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_capture(
    df: DataFrame, scores: list[str], observed: str, length: str, block: str, tie: str, reps: int = 200, share: float = 0.1, seed: int = 0, level: float = 0.95
) -> DataFrame:
    """(method, low, high): percentile interval of each score's capture over resampled blocks."""
    return _interval(resampled_captures(df, scores, observed, length, block, tie, reps, share, seed), ["method"], "c", level)


def capture_gains(
    df: DataFrame, ours: str, others: list[str], observed: str, length: str, block: str, tie: str, reps: int = 200, share: float = 0.1, seed: int = 0, level: float = 0.95,
    draws: DataFrame | None = None,
) -> DataFrame:
    """(method, gain, low, high): what `ours` captures more than each other score, and its interval over the same draws of blocks for both."""
    names = [ours, *others]
    each = resampled_captures(df, names, observed, length, block, tie, reps, share, seed, draws)
    mine = each.where(F.col("method") == ours).select("rep", F.col("c").alias("mine"))
    gains = each.where(F.col("method") != ours).join(mine, "rep").withColumn("d", F.col("mine") - F.col("c"))
    got = None
    for n in names:
        one = capture(df, n, observed, length, tie, share).select(F.lit(n).alias("method"), F.col("share").alias("whole"))
        got = one if got is None else got.unionByName(one)
    best = got.where(F.col("method") == ours).select(F.col("whole").alias("best"))
    point = got.where(F.col("method") != ours).join(F.broadcast(best)).select("method", (F.col("best") - F.col("whole")).alias("gain"))
    return point.join(_interval(gains, ["method"], "d", level), "method")


def poisson_times(*key: Column) -> Column:
    """How often a row comes up in a resampling: Poisson with mean 1, by a digest of the key."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("double") / 2.0**32
    total, term, out = 0.0, float(np.exp(-1.0)), F.lit(0)
    for k in range(1, 12):
        total, term = total + term, term / k
        out = F.when(u >= total, k).otherwise(out)
    return out


def bootstrap_interval(df: DataFrame, stat: Callable[[Column], Column], key: list[str], reps: int = 500, level: float = 0.95) -> DataFrame:
    """(low, high): percentile interval of a statistic over resamplings of the rows.

    `stat` makes an aggregate from the column that says how often a row counts. Each row
    draws that number for each resampling from a digest of its key, so nothing is shuffled
    but one row per task and resampling. Resamplings without a value do not count.
    """
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("__rep"))
    times = poisson_times(*[F.col(k).cast("string") for k in key], F.col("__rep").cast("string"))
    drawn = each.withColumn("__times", times).groupBy("__rep").agg(stat(F.col("__times")).alias("v"))
    return _interval(drawn.where("v is not null and not isnan(v)"), [], "v", level)


def block_times(block: Column, reps: int) -> Column:
    """Draws of a block (array of struct rep, times): how often it comes up in each resampling, Poisson with mean 1, by a digest of the block and the draw.

    Nothing is drawn on the driver, and each task finds the same draws, however many blocks there are. Draws of 0 are left out.
    """
    draws = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.struct(r.alias("rep"), poisson_times(F.coalesce(block.cast("string"), F.lit("")), r.cast("string")).alias("times")))
    return F.filter(draws, lambda d: d["times"] > 0)


def block_interval(df: DataFrame, sums: dict[str, Column], stat: Column, block: str, reps: int = 200, level: float = 0.95, draws: DataFrame | None = None) -> DataFrame:
    """(value, low, high): a statistic of sums, and its percentile interval over resamplings of whole blocks.

    `sums` are columns to be added up, `stat` is made of their names: a mean is `total / n`, a ratio `a / b`. A draw is the product of
    the blocks' sums and how often each comes up, so rows are read once, whatever the number of draws. Nulls add nothing. Draws
    without a value do not count. `draws` (rep, block, times) are those of `block_times` if not given.
    """
    blocks = df.groupBy(block).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    if draws is None:
        drawn = blocks.select(*sums, F.inline(block_times(F.col(block), reps)))
    else:
        drawn = blocks.join(draws, block)
    each = drawn.groupBy("rep").agg(*[F.sum(F.col(n) * F.col("times")).alias(n) for n in sums]).select("rep", stat.alias("v"))
    whole = blocks.agg(*[F.sum(n).alias(n) for n in sums]).select(stat.alias("value"))
    return whole.join(F.broadcast(_interval(each.where("v is not null and not isnan(v)"), [], "v", level)))


def block_auc(df: DataFrame, score: str, label: Column, block: str, reps: int = 200, level: float = 0.95, draws: DataFrame | None = None) -> DataFrame:
    """(value, low, high): the AUC of a score, and its percentile interval over resamplings of whole blocks.

    A draw weighs rows and does not move them, so the different (score, block) are dealt by range of the score once. Below a range
    lie the negatives of the ranges before it, one number a range and draw; within it the score's order counts. No task holds more than a
    range. Ties count half; draws with one class only do not count. Rows without a score are left out.
    """
    rows = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s"), F.col(block).alias("block"))
    held = ranged(rows.agg(F.sum(label.cast("long")).alias("p"), F.sum(1 - label.cast("long")).alias("n")), [F.col("s")])
    if draws is None:
        drawn = held.select("part", "s", "p", "n", F.inline(block_times(F.col("block"), reps)))
    else:
        drawn = held.join(draws.withColumnRenamed(block, "block"), "block")
    whole = held.select("part", "s", "p", "n", F.lit(-1).alias("rep"), F.lit(1).alias("times"))  # draw -1 is the data as they are
    drawn = drawn.select(whole.columns).unionByName(whole)
    steps = Scratch(df.sparkSession).write(drawn.groupBy("part", "rep", "s").agg(F.sum(F.col("p") * F.col("times")).alias("p"), F.sum(F.col("n") * F.col("times")).alias("n")))
    before = Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = steps.groupBy("part", "rep").agg(F.sum("n").alias("n")).select("part", "rep", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    own = Window.partitionBy("part", "rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    pairs = steps.join(parts, ["part", "rep"]).withColumn("under", F.col("below") + F.coalesce(F.sum("n").over(own), F.lit(0)) + F.col("n") / 2)
    value = F.sum(F.col("p") * F.col("under")) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0)).cast("double")
    each = Scratch(df.sparkSession).write(pairs.groupBy("rep").agg(value.alias("v")))
    return each.where("rep = -1").select(F.col("v").alias("value")).join(F.broadcast(_interval(each.where("rep >= 0 and v is not null"), [], "v", level)))


def tie_order(seed: int, *key: Column) -> Column:
    """A number that orders equal scores by chance, the same for one seed."""
    return F.xxhash64(F.lit(seed), *key)


def benchmark(df: DataFrame, ours: str, others: list[str], observed: str, length: str, block: str, tie: str, reps: int = 200, seed: int = 0) -> DataFrame:
    """(method, capture10, capture5, auc, low, high, gain, gain_low, gain_high): how each score ranks the rows.

    The interval is of capture10, gains are those of `ours` over the method (null for itself),
    auc tells rows with an observation from those without.
    """
    names, out = [ours, *others], None
    for n in names:
        at = [capture(df, n, observed, length, tie, x).select(F.col("share").alias(c)) for x, c in ((0.1, "capture10"), (0.05, "capture5"))]
        one = at[0].join(F.broadcast(at[1])).join(F.broadcast(auc(df, n, F.col(observed) > 0))).withColumn("method", F.lit(n))
        out = one if out is None else out.unionByName(one)
    low = _interval(resampled_captures(df, names, observed, length, block, tie, reps, 0.1, seed), ["method"], "c", 0.95)
    gains = capture_gains(df, ours, others, observed, length, block, tie, reps, 0.1, seed).toDF("method", "gain", "gain_low", "gain_high")
    return out.join(low, "method").join(gains, "method", "left").select("method", "capture10", "capture5", "auc", "low", "high", "gain", "gain_low", "gain_high")


def targets(bench: DataFrame, least: dict[str, float]) -> DataFrame:
    """(method, target, met): whether a column of a benchmark reaches a bar that was set before; a null does not."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.coalesce(F.col(c) >= v, F.lit(False)).alias("met")) for c, v in least.items()])).alias("t")
    return bench.select("method", rows).select("method", "t.*")


def temporal_gains(cells: DataFrame, predicted: str, observed: str, hours: str, group: str, by: list[str]) -> DataFrame:
    """(deviance, vs_flat, vs_by): shape deviance of predicted counts, and the share of it that they save against flat rates.

    The flat rate is one per `group`, the other baseline one per `group` and `by`; both come
    from the same cells, times their hours.
    """
    total = lambda keys: F.sum(observed).over(Window.partitionBy(*keys)) / F.sum(hours).over(Window.partitionBy(*keys)) * F.col(hours)
    rows = cells.withColumns({"__flat": total([group]), "__by": total([group, *by])})  # cells are a fixed set of kinds of hour
    d = [shape_deviance(rows, c, observed).select(F.col("deviance").alias(n)) for c, n in ((predicted, "deviance"), ("__flat", "a"), ("__by", "b"))]
    both = d[0].join(F.broadcast(d[1])).join(F.broadcast(d[2]))
    return both.select("deviance", (1 - F.col("deviance") / F.col("a")).alias("vs_flat"), (1 - F.col("deviance") / F.col("b")).alias("vs_by"))


def fold_of_group(sizes: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups by size, largest first, each to the fold that is lightest so far.

    Takes one row per group (group, n); groups are a fixed set of areas, of which more than
    MOST_AREAS are an error.
    """
    _areas(sizes, group)
    load, rows = [0] * folds, []
    for r in sizes.orderBy(F.desc("n"), group).collect():
        k = load.index(min(load))
        load[k] += r["n"]
        rows.append((r[group], k))
    schema = f"{group} {sizes.schema[group].dataType.simpleString()}, fold int"
    return sizes.sparkSession.createDataFrame(rows, schema)
