"""Count models: ridge Poisson regression, monotone Poisson boosting, and what surrounds them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from meridian.functions import times
from meridian.plans.scratch import Scratch


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with z_<column>: less the mean, over the sample standard deviation (1 where that is 0)."""
    stats = df.agg(*[F.avg(c).alias(f"__m{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s{c}") for c in columns])
    out = df.join(F.broadcast(stats))
    scale = lambda c: F.coalesce(F.nullif(F.col(f"__s{c}"), F.lit(0.0)), F.lit(1.0))
    return out.withColumns({f"z_{c}": (F.col(c) - F.col(f"__m{c}")) / scale(c) for c in columns}).select(*df.columns, *[f"z_{c}" for c in columns])


def one_hot(df: DataFrame, column: str, levels: list[str], reference: str) -> tuple[DataFrame, list[str]]:
    """`df` with a 0/1 column for each level but the reference, and their names. Other values are all 0."""
    names = {f"{column}_{v}".replace("-", "_"): v for v in levels if v != reference}
    return df.withColumns({n: F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for n, v in names.items()}), list(names)


@dataclass(frozen=True)
class LogLinear:
    """log rate = intercept + sum of coefficient * column; a missing column counts as 0."""

    intercept: float
    coefficients: dict[str, float]

    def log_rate(self, columns: list[str]) -> Column:
        return F.lit(self.intercept) + sum((F.lit(b) * F.col(c) for c, b in self.coefficients.items() if c in columns), F.lit(0.0))

    def part(self, columns: list[str], having: str) -> Column:
        """What the columns whose name contains `having` add to the log rate."""
        return sum((F.lit(b) * F.col(c) for c, b in self.coefficients.items() if having in c and c in columns), F.lit(0.0))


def poisson_ridge(df: DataFrame, features: list[str], y: str, exposure: str, alpha: float) -> LogLinear:
    """Poisson regression of y / exposure with weight exposure and penalty alpha / 2 * |b|^2 on the mean half-deviance.

    MLlib divides by the weighted rate as well, so its penalty is alpha over the mean rate.
    Rows with a null or without exposure are left out.
    """
    rows = df.where(F.col(exposure) > 0).dropna(subset=[*features, y, exposure])
    rows = rows.withColumn("__rate", F.col(y) / F.col(exposure))
    rate = rows.agg(F.sum(y) / F.sum(exposure)).first()[0]
    if not rate:
        return LogLinear(float("-inf"), dict.fromkeys(features, 0.0))
    ready = VectorAssembler(inputCols=features, outputCol="__x").transform(rows)
    glr = GeneralizedLinearRegression(
        family="poisson", link="log", featuresCol="__x", labelCol="__rate", weightCol=exposure, regParam=alpha / rate, maxIter=50, tol=1e-10
    )
    m = glr.fit(ready)
    return LogLinear(float(m.intercept), dict(zip(features, map(float, m.coefficients))))


def best_alpha(df: DataFrame, features: list[str], y: str, exposure: str, fold: str, grid: list[float]) -> float:
    """The alpha with the least sum of held-out deviances over the folds; the first of equals."""
    from meridian.operators.evaluate import deviance

    df = Scratch(df.sparkSession).write(df.select(*features, y, exposure, fold))
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    losses = []
    for a in grid:
        total = 0.0
        for k in folds:
            m = poisson_ridge(df.where(F.col(fold) != k), features, y, exposure, a)
            mu = F.exp(m.log_rate(features)) * F.col(exposure)
            total += df.where(F.col(fold) == k).agg(deviance(F.col(y), mu)).first()[0] or 0.0
        losses.append(total)
    return grid[losses.index(min(losses))]


def best_blend(df: DataFrame, y: str, log_a: str, log_b: str, points: int = 11) -> DataFrame:
    """(w, deviance): the weight w of log_a against log_b on an even grid with the least deviance of y."""
    from meridian.operators.evaluate import deviance

    grid = F.posexplode(F.array(*[F.lit(i / (points - 1)) for i in range(points)])).alias("i", "w")
    tried = df.select(y, log_a, log_b, grid)
    mu = F.exp(F.col("w") * F.col(log_a) + (1 - F.col("w")) * F.col(log_b))
    losses = tried.groupBy("i", "w").agg(deviance(F.col(y), mu).alias("d"))
    return losses.agg(F.min(F.struct("d", "i", "w")).alias("m")).select("m.w", F.col("m.d").alias("deviance"))


@dataclass
class Tree:
    """A tree as arrays: feature -1 marks a leaf; rows whose bin is at most `cut` go left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)

    def add(self, value: float, weight: float) -> int:
        for a, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.weight, weight)):
            a.append(v)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), int)
        feature, cut, left, right = (np.array(a) for a in (self.feature, self.cut, self.left, self.right))
        while len(bins) and (feature[at] >= 0).any():
            go = feature[at] >= 0
            f = np.maximum(feature[at], 0)
            down = np.where(bins[np.arange(len(bins)), f] <= cut[at], left[at], right[at])
            at = np.where(go, down, at)
        return at


@dataclass
class Boosted:
    base: float
    cuts: list[np.ndarray]
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def log_mu(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += self.rate * np.array(t.value)[t.leaves(bins)]
        return out

    def contributions(self, row: np.ndarray) -> tuple[float, np.ndarray]:
        """(expected value, per-feature parts) of one row of bins, which add up to its log_mu.

        A tree's parts are the average over all orders of its own features of what each adds
        when features are fixed one by one; the others follow the training weights.
        """
        base, parts = self.base, np.zeros(len(self.cuts))
        for t in self.trees:
            used = sorted({f for f in t.feature if f >= 0})

            def mean(known: frozenset, i: int = 0, t: Tree = t) -> float:
                if t.feature[i] < 0:
                    return t.value[i]
                if t.feature[i] in known:
                    return mean(known, t.left[i] if row[t.feature[i]] <= t.cut[i] else t.right[i])
                a, b = t.left[i], t.right[i]
                return (t.weight[a] * mean(known, a) + t.weight[b] * mean(known, b)) / (t.weight[a] + t.weight[b])

            base += self.rate * mean(frozenset())
            orders = list(permutations(used))
            for order in orders:
                known: frozenset = frozenset()
                for f in order:
                    parts[f] += self.rate * (mean(known | {f}) - mean(known)) / len(orders)
                    known |= {f}
        return base, parts


@dataclass(frozen=True)
class Growth:
    """How trees grow: `rows` and `columns` are the shares that each tree sees, drawn by `seed`."""

    rate: float = 0.1
    depth: int = 2
    bins: int = 32
    l2: float = 5.0
    least: int = 60
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 0


#: Rounds after which the log rates of rows are written again; rows of sums that a task has, about.
AGAIN, CELLS = 16, 20_000


class _Boosting:
    """Boosted models that grow side by side: one of all rows, or one per fold of the rows outside it.

    Tasks add up gradients by (model, node, feature, bin) and held-out losses by model; Spark
    adds up the tasks; the driver sees models * nodes * features * bins sums however many rows
    there are, and picks the splits. Where trees see all rows, those of a fold with the same bins
    are one row of sums from the start, so a pass goes over bins, not over rows; every AGAIN rounds the log
    rates so far are written with them, so a pass looks at the last trees only.
    """

    def __init__(self, df: DataFrame, features: list[str], y: str, exposure: str, monotone: list[str], growth: Growth, fold: str | None):
        self.growth, self.features = growth, features
        cuts = [np.unique(e) for e in df.approxQuantile(features, [i / growth.bins for i in range(1, growth.bins)], 0.001)]
        rows = df.select(
            F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(y).cast("double").alias("y"), F.col(exposure).cast("double").alias("e"),
            (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), F.rand(growth.seed).alias("u"),
        )

        @F.pandas_udf("array<int>")
        def binned(x: pd.Series) -> pd.Series:
            return pd.Series(list(Boosted(0.0, cuts, 0.0).bins(np.stack(x)).astype(np.int32))) if len(x) else pd.Series([], dtype=object)

        own = F.when(F.col("y") > 0, F.col("y") * (F.ln("y") - F.ln(F.greatest("e", F.lit(1e-12))))).otherwise(0.0)  # what of a row's deviance no model changes
        rows = rows.select("fold", binned("x").alias("b"), "y", "e", own.alias("own"), F.lit(1).cast("long").alias("n"), "u")
        self.scratch = Scratch(df.sparkSession)
        if growth.rows >= 1:
            sums = [F.sum(c).alias(c) for c in ("y", "e", "own", "n")]
            rows = self.scratch.write(rows.groupBy("fold", "b").agg(*sums).withColumn("u", F.lit(0.0)))
            rows = rows.repartition(rows.count() // CELLS + 1)
        self.held, self.told = self.scratch.write(rows.withColumn("f", F.array().cast("array<double>"))), None
        sums = self.held.groupBy("fold").agg(F.sum("y").alias("y"), F.sum("e").alias("e")).orderBy("fold").collect()
        self.folds = [r["fold"] for r in sums]
        rest = [(sum(r["y"] for r in sums if r["fold"] != k or not fold), sum(r["e"] for r in sums if r["fold"] != k or not fold)) for k in self.folds]
        self.models = [Boosted(float(np.log(max(y, 1e-12) / e)), cuts, growth.rate) for y, e in rest] if sums else [Boosted(0.0, cuts, growth.rate)]
        self.width, self.up = max(len(c) for c in cuts) + 1, {features.index(m) for m in monotone}
        self.crossed = fold is not None

    def _rated(self) -> Callable[[pd.DataFrame], tuple[np.ndarray, list[np.ndarray]]]:
        """What tells the bins of rows and the log rates of each model, from those written last."""
        told, n = self.told, len(self.features)
        bases = [m.base for m in self.models]
        late = [Boosted(0.0, m.cuts, m.rate, m.trees[told[i] if told else 0 :]) for i, m in enumerate(self.models)]

        def rated(f: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
            b = np.stack(f["b"]) if len(f) else np.empty((0, n), int)
            before = np.stack(f["f"]) if told and len(f) else np.tile(bases, (len(f), 1))
            return b, [before[:, i] + m.log_mu(b) for i, m in enumerate(late)]

        return rated

    def _tell(self) -> None:
        """Write the log rates so far with the rows."""
        rated, before = self._rated(), self.held

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(f=list(np.stack(rated(f)[1], axis=1)))

        self.held = self.scratch.write(before.mapInPandas(run, before.schema))
        self.scratch.free(before)
        self.told = [len(m.trees) for m in self.models]

    def _sums(self, trees: list[Tree], turn: int) -> tuple[dict[tuple[int, int], np.ndarray], float]:
        """Gradients by (model, node), and the mean deviance of the rows outside each model's own, over all models."""
        models, folds, growth, crossed, width, n = self.models, self.folds, self.growth, self.crossed, self.width, len(self.features)
        rated = self._rated()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for f in frames:
                b, log_mu = rated(f)
                y, e, of, u, own, count = (f[c].to_numpy() for c in ("y", "e", "fold", "u", "own", "n"))
                drawn = (u * 2654435761.0 * (turn + 1)) % 1.0 < growth.rows
                for m in range(len(models)):
                    mu = e * np.exp(log_mu[m])
                    out = of == folds[m] if crossed else np.zeros(len(f), bool)
                    if out.any():
                        part = own[out] - y[out] * log_mu[m][out] - (y[out] - mu[out])
                        s = sums.setdefault((m, -1), np.zeros(2))
                        s += (2 * part.sum(), count[out].sum())
                    at = trees[m].leaves(b)
                    for node in np.unique(at[~out & drawn]):
                        s = sums.setdefault((m, int(node)), np.zeros((3, n, width)))
                        k = (at == node) & ~out & drawn
                        for j in range(n):
                            for r, v in enumerate((y[k] - mu[k], mu[k], count[k])):
                                s[r, j] += np.bincount(b[k, j], v, width)
            for (m, node), s in sums.items():
                yield pd.DataFrame({"m": m, "node": node, "i": np.arange(s.size), "v": s.ravel()})

        rows = self.held.mapInPandas(run, "m int, node int, i int, v double").groupBy("m", "node", "i").agg(F.sum("v").alias("v")).toPandas()
        found, loss = {}, np.zeros(2)
        for (m, node), g in rows.groupby(["m", "node"]):
            s = np.zeros(2 if node < 0 else 3 * n * width)
            s[g["i"]] = g["v"]
            if node < 0:
                loss += s
            else:
                found[int(m), int(node)] = s.reshape(3, n, width)
        return found, float(loss[0] / loss[1]) if loss[1] else float("nan")

    def _split(self, tree: Tree, node: int, s: np.ndarray, limits: dict[int, tuple[float, float]], columns: list[int]) -> bool:
        """Split a node where that gains most. A split on a monotone feature must not lower the rate upwards, and children keep to its middle."""
        growth, (lo, hi) = self.growth, limits[node]
        g, h, n = (s[r].cumsum(axis=1) for r in range(3))
        if node == 0:
            tree.weight[0] = float(n[0, -1])
        best = (1e-9, 0, 0, 0.0, 0.0)
        for j in columns:
            gl, hl, nl = g[j, :-1], h[j, :-1], n[j, :-1]
            gr, hr, nr = g[j, -1] - gl, h[j, -1] - hl, n[j, -1] - nl
            vl, vr = np.clip(gl / (hl + growth.l2), lo, hi), np.clip(gr / (hr + growth.l2), lo, hi)
            gain = gl**2 / (hl + growth.l2) + gr**2 / (hr + growth.l2) - g[j, -1] ** 2 / (h[j, -1] + growth.l2)
            gain[(nl < growth.least) | (nr < growth.least) | ((vl > vr) if j in self.up else False)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        if best[0] <= 1e-9:
            return False
        _, j, k, vl, vr = best
        tree.feature[node], tree.cut[node] = j, k
        tree.left[node], tree.right[node] = tree.add(vl, float(n[j, k])), tree.add(vr, float(n[j, -1] - n[j, k]))
        middle = (vl + vr) / 2
        limits[tree.left[node]] = (lo, min(hi, middle) if j in self.up else hi)
        limits[tree.right[node]] = (max(lo, middle) if j in self.up else lo, hi)
        return True

    def grow(self, turn: int) -> float:
        """Add a tree to every model that can be split; the held-out deviance before that."""
        if turn and turn % AGAIN == 0:
            self._tell()
        rng = np.random.default_rng((self.growth.seed, turn))
        n, loss = len(self.features), float("nan")
        columns = sorted(rng.permutation(n)[: max(1, round(self.growth.columns * n))].tolist())
        trees = [Tree() for _ in self.models]
        for t in trees:
            t.add(0.0, 0.0)
        limits = [{0: (-np.inf, np.inf)} for _ in trees]
        for level in range(self.growth.depth):
            found, now = self._sums(trees, turn)
            loss = now if level == 0 else loss
            if not any([self._split(trees[m], node, s, limits[m], columns) for (m, node), s in found.items() if node in limits[m]]):
                break
        for model, tree in zip(self.models, trees):
            if tree.feature[0] >= 0:
                model.trees.append(tree)
        return loss


def fit_boosted(df: DataFrame, features: list[str], y: str, exposure: str, monotone: list[str] = (), rounds: int = 20, **growth: float) -> Boosted:
    """Gradient boosting of a Poisson rate by histogram trees, grown level by level; `growth` as in Growth.

    A rise in a feature of `monotone` never lowers the rate. Every leaf has at least `least`
    rows. Without rows that can be split there are fewer trees than rounds.
    """
    boosting = _Boosting(df, features, y, exposure, list(monotone), Growth(**growth), None)
    for turn in range(rounds):
        had = len(boosting.models[0].trees)
        boosting.grow(turn)
        if len(boosting.models[0].trees) == had and boosting.growth.columns == boosting.growth.rows == 1:
            break
    return boosting.models[0]


def boosting_rounds(
    df: DataFrame, features: list[str], y: str, exposure: str, fold: str, monotone: list[str] = (), most: int = 200, patience: int = 10, **growth: float
) -> tuple[int, list[float], dict[int, Boosted]]:
    """(rounds, deviance after each number of rounds from 0, model of each fold at `rounds`) by cross-validation over folds.

    The models of all folds grow side by side, one pass over the rows for each level of all
    their trees, which also gives the deviance of the rows that a model has not seen. It ends
    when that has not fallen for `patience` rounds, or after `most`.
    """
    boosting, losses = _Boosting(df, features, y, exposure, list(monotone), Growth(**growth), fold), []
    counts: list[list[int]] = []
    for turn in range(most + 1):
        counts.append([len(m.trees) for m in boosting.models])
        losses.append(boosting.grow(turn))
        if turn - int(np.argmin(losses)) >= patience:
            break
    best = int(np.argmin(losses))
    models = {k: Boosted(m.base, m.cuts, m.rate, m.trees[: counts[best][i]]) for i, (k, m) in enumerate(zip(boosting.folds, boosting.models))}
    return best, losses, models


@dataclass(frozen=True)
class Ensemble:
    """log rate = weight * boosted + (1 - weight) * linear; what cross-validation chose, and the overdispersion k of its forecasts."""

    features: list[str]
    linear: LogLinear
    boosted: Boosted
    weight: float
    alpha: float
    rounds: int
    k: float


def fit_ensemble(
    df: DataFrame, features: list[str], y: str, exposure: str, group: str, monotone: list[str] = (), alphas: tuple[float, ...] = (0.001, 0.01, 0.1), folds: int = 5, most: int = 200, **growth: float
) -> Ensemble:
    """Fit by forecasts of rows that a model has not seen: rounds, then alpha, then the weight and k on those forecasts, then all rows.

    Folds are whole groups (fixed areas). `features` should be standardised for the linear part.
    """
    from meridian.operators.evaluate import fold_of_group, overdispersion

    dealt = fold_of_group(df.groupBy(group).agg(F.count("*").alias("n")), group, folds)
    rows = Scratch(df.sparkSession).write(df.join(F.broadcast(dealt), group).withColumnRenamed("fold", "__fold"))
    rounds, _, models = boosting_rounds(rows, features, y, exposure, "__fold", monotone, most, **growth)
    alpha, out = best_alpha(rows, features, y, exposure, "__fold", list(alphas)), None
    for k, m in models.items():
        linear = poisson_ridge(rows.where(F.col("__fold") != k), features, y, exposure, alpha)
        seen = predict_boosted(rows.where(F.col("__fold") == k), m, features, "__b").withColumn("__a", linear.log_rate(features))
        log_e = F.ln(exposure)
        seen = seen.select(F.col(y).cast("double").alias("y"), (F.col("__b") + log_e).alias("b"), (F.col("__a") + log_e).alias("a"))
        out = seen if out is None else out.unionByName(seen)
    out = Scratch(df.sparkSession).write(out)
    weight = float(best_blend(out, "y", "b", "a").first()["w"])
    mu = out.withColumn("mu", F.exp(weight * F.col("b") + (1 - weight) * F.col("a")))
    k = float(overdispersion(mu, "y", "mu").first()["k"])
    return Ensemble(list(features), poisson_ridge(rows, features, y, exposure, alpha), fit_boosted(rows, features, y, exposure, monotone, rounds, **growth), weight, alpha, rounds, k)


def predict_ensemble(df: DataFrame, m: Ensemble, name: str = "log_mu") -> DataFrame:
    """`df` with the ensemble's log rate."""
    out = predict_boosted(df, m.boosted, m.features, "__b")
    return out.withColumn(name, m.weight * F.col("__b") + (1 - m.weight) * m.linear.log_rate(m.features)).drop("__b")


def explain_ensemble(df: DataFrame, m: Ensemble) -> DataFrame:
    """`df` with base and parts (a number per feature, in their order), which add up to the ensemble's log rate.

    Rows in the same bins have the same parts of the trees, so each task works those out once.
    """
    shared, linear = df.sparkSession.sparkContext.broadcast(m.boosted), m.linear

    @F.pandas_udf("array<double>")
    def told(x: pd.Series) -> pd.Series:
        boosted = shared.value
        if not len(x):
            return pd.Series([], dtype=object)
        bins, which = np.unique(boosted.bins(np.stack(x)), axis=0, return_inverse=True)
        each = [np.r_[base, parts] for base, parts in map(boosted.contributions, bins)]
        return pd.Series([each[i] for i in which.ravel()])

    out = df.withColumn("__t", told(F.array(*[F.col(c).cast("double") for c in m.features])))
    part = lambda i, c: m.weight * F.col("__t")[i + 1] + (1 - m.weight) * linear.coefficients[c] * F.col(c)
    parts = F.array(*[part(i, c) for i, c in enumerate(m.features)])
    return out.withColumns({"base": m.weight * F.col("__t")[0] + (1 - m.weight) * linear.intercept, "parts": parts}).drop("__t")


def predict_boosted(df: DataFrame, model: Boosted, features: list[str], name: str = "log_mu") -> DataFrame:
    """`df` with the model's log rate."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series(m.log_mu(m.bins(np.stack(x)))) if len(x) else pd.Series([], dtype=float)

    return df.withColumn(name, run(F.array(*[F.col(c).cast("double") for c in features])))


def multipliers(cells: DataFrame, log_rate: str, group: str, hours: str) -> DataFrame:
    """`cells` with multiplier: the rate over its group's mean rate, weighted by hours, so that means are 1."""
    rate = F.exp(log_rate)
    mean = cells.groupBy(group).agg((F.sum(rate * F.col(hours)) / F.sum(hours)).alias("__m"))
    return cells.join(mean, group).withColumn("multiplier", rate / F.col("__m")).drop("__m")


# --- the temporal design

#: The columns of each factor, by a pattern of their names; what they leave is the baseline.
TEMPORAL_FACTORS = {"time_of_day": "hour", "day_of_week": "day_group", "light": "light", "rain": "wet"}
#: Levels of the design and the one that each is measured against.
HOUR_BINS = ["0-5", "6-9", "10-14", "15-18", "19-23"]
DAY_GROUPS, LIGHTS = ["weekday", "friday", "saturday", "sunday"], ["day", "twilight", "dark"]


@dataclass(frozen=True)
class TemporalDesign:
    """What a model of counts by kind of hour is made of: levels of the group (the first is the reference) and of the year."""

    group: str
    levels: tuple[str, ...]
    flag: str
    years: tuple[int, ...] = ()

    def columns(self, flag: Column | None = None, years: bool = True) -> dict[str, Column]:
        """0/1 columns by name: main effects, and `flag:` columns that hold for flagged rows only. `flag` in place of the cell's own."""
        f = (F.col(self.flag) if flag is None else flag).cast("double")
        hot = lambda c, levels, ref: {f"{c}={v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v in levels if v != ref}
        wet = F.coalesce(F.col("wet").cast("double"), F.lit(0.0))
        group, day, light = hot(self.group, self.levels, self.levels[0]), hot("day_group", DAY_GROUPS, "weekday"), hot("light", LIGHTS, "day")
        hours = {f"hour={h}": (F.col("hour") == h).cast("double") for h in range(24) if h != 12}
        bins = {f"hour_bin={v}": (times.hour_bin(F.col("hour")) == v).cast("double") for v in HOUR_BINS if v != "10-14"}
        year = {f"year={y}": F.coalesce((F.col("year") == y).cast("double"), F.lit(0.0)) if years else F.lit(0.0) for y in self.years[1:]}
        out = {"flag": f} | group | day | hours | light | {"wet": wet}
        out |= {f"flag:{n}": c * f for n, c in (light | bins | day | group | {"wet": wet}).items()} | year | {f"flag:{n}": c * f for n, c in year.items()}
        return out


@dataclass(frozen=True)
class TemporalModel:
    """log rate = intercept + sum of coefficient * column of the design."""

    design: TemporalDesign
    intercept: float
    coefficients: dict[str, float]

    def log_rate(self, flag: Column | None = None) -> Column:
        """The log rate of a cell in the reference year, flagged or not."""
        return F.lit(self.intercept) + self._sum(self.design.columns(flag, years=False), lambda n: True)

    def _sum(self, columns: dict[str, Column], has: Callable[[str], bool]) -> Column:
        return sum((F.lit(self.coefficients[n]) * c for n, c in columns.items() if has(n)), F.lit(0.0))

    def parts(self, cells: DataFrame, reference: DataFrame | None = None) -> DataFrame:
        """`cells` with multiplier, factors (a struct of TEMPORAL_FACTORS) and base, for flagged rows: the factors and base add up to log(multiplier).

        The multiplier is the rate over its group's mean rate in `reference` (the cells, if not given), weighted by hours, so that it
        averages to 1 in each group there. A group that the reference lacks has a null multiplier and base.
        """
        flag = F.lit(1.0)
        rate = F.exp(self.log_rate(flag))
        mean = (cells if reference is None else reference).groupBy(self.design.group).agg((F.sum(rate * F.col("hours")) / F.sum("hours")).alias("__mean"))
        columns = self.design.columns(flag, years=False)
        factors = {f: self._sum(columns, lambda n, p=p: n.endswith(p) if p == "wet" else p in n) for f, p in TEMPORAL_FACTORS.items()}
        out = cells.join(F.broadcast(mean), self.design.group, "left")  # groups are levels of the design
        out = out.withColumns({"factors": F.struct(*[c.alias(f) for f, c in factors.items()]), "__log": self.log_rate(flag) - F.ln("__mean")})
        base = F.col("__log") - sum((F.col(f"factors.{f}") for f in factors), F.lit(0.0))
        return out.withColumns({"multiplier": F.exp("__log"), "base": base}).drop("__mean", "__log")

    def effects(self) -> dict[str, float]:
        """Headline multipliers of flagged rows: main effect and interaction together, and the interaction with dark alone."""
        c = lambda n: self.coefficients.get(n, 0.0)
        both = {k: float(np.exp(c(n) + c(f"flag:{n}"))) for k, n in (("dark", "light=dark"), ("twilight", "light=twilight"), ("wet", "wet"))}
        return both | {"flag_x_dark": float(np.exp(c("flag:light=dark")))}


def newton_poisson(df: DataFrame, features: dict[str, Column], y: str, exposure: str, alpha: float, rounds: int = 50, tol: float = 1e-10) -> LogLinear:
    """Poisson regression as `poisson_ridge` has it, by Newton steps that are halved until they help, so that levels without any count do no harm.

    Each step adds up a gradient and a matrix of the features' number squared in every task, and solves it on the driver, so
    features are few hundred at most. Rows with a null or without exposure are left out.
    """
    k = len(features) + 1
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(exposure).cast("double").alias("e"), F.array(F.lit(1.0), *[c.cast("double") for c in features.values()]).alias("x"))
    rows = Scratch(df.sparkSession).write(rows.where("y is not null and e > 0 and not exists(x, v -> v is null)"))
    total = rows.agg(F.sum("y"), F.sum("e")).first()
    if not total[0]:
        return LogLinear(float("-inf"), dict.fromkeys(features, 0.0))
    ridge = np.r_[0.0, np.full(k - 1, alpha)]

    def sums(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, g, h = 0.0, np.zeros(k), np.zeros((k, k))
            for f in frames:
                if len(f):
                    x, e, n = np.stack(f["x"]), f["e"].to_numpy(), f["y"].to_numpy()
                    eta = np.minimum(x @ b, 300.0)
                    mu = e * np.exp(eta)
                    loss, g, h = loss + float((mu - n * eta).sum()), g + x.T @ (mu - n), h + (x * mu[:, None]).T @ x
            yield pd.DataFrame({"loss": [loss], "g": [g], "h": [h.ravel()]})

        got = rows.mapInPandas(run, "loss double, g array<double>, h array<double>").toPandas()
        loss, g, h = got["loss"].sum(), np.sum(np.stack(got["g"]), axis=0), np.sum(np.stack(got["h"]), axis=0).reshape(k, k)
        return float(loss / total[1] + ridge @ b**2 / 2), g / total[1] + ridge * b, h / total[1] + np.diag(ridge)

    b = np.r_[np.log(total[0] / total[1]), np.zeros(k - 1)]
    loss, g, h = sums(b)
    for _ in range(rounds):
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        gain, scale = float(g @ step), 1.0
        if gain < tol * max(1e-12, abs(loss)):
            break
        while scale > 1e-6:
            new = sums(b - scale * step)
            if new[0] <= loss - 1e-4 * scale * gain:
                break
            scale /= 2
        else:
            break
        b, (loss, g, h) = b - scale * step, new
    return LogLinear(float(b[0]), dict(zip(features, map(float, b[1:]))))


def fit_temporal(cells: DataFrame, group: str, levels: list[str], flag: str, alpha: float = 1e-3, scale: float = 10_000.0) -> TemporalModel:
    """Fit counts by kind of hour: cells of `group`, day_group, hour, light, wet, `flag`, count, hours and perhaps year.

    Years take up changes in what was recorded; cells without one are of the first. Rates are taken per `scale` hours, so that the penalty
    does not shrink real effects of rare events. Cells are a fixed set of kinds of hour, summed before.
    """
    years = tuple(sorted(r[0] for r in cells.select("year").distinct().collect() if r[0] is not None)) if "year" in cells.columns else ()
    design = TemporalDesign(group, tuple(levels), flag, years)
    m = newton_poisson(cells.withColumn("__y", F.col("count") * scale), design.columns(), "__y", "hours", alpha)
    return TemporalModel(design, m.intercept - float(np.log(scale)), m.coefficients)
