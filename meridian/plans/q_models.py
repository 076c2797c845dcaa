"""Named queries over shrinkage, evaluation, models and scores.

Years of shipments stand in for years of counts: suppliers are the units, their account
balance the length, their nation the block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meridian.functions import times
from meridian.operators import evaluate, models, ranking, rollup, scoring
from meridian.plans.registry import Registry, table
from meridian.plans.scratch import Scratch

Q = Registry()
POINTS = [i / 1000 for i in range(1001)]
GRID = [0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]


def units(spark: SparkSession, d: str) -> DataFrame:
    """(id, block, length, y, z, mu): counts of four training years and of the year after; mu spreads the total by length."""
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year"), "l_returnflag")
    flag = F.col("l_returnflag") == "R"
    count = lambda *years: F.sum(F.when(flag & F.col("year").between(*years), 1).otherwise(0))
    counts = items.groupBy("id").agg(count(1995, 1998).alias("y"), count(1999, 1999).alias("z"))
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("block"), F.greatest(F.abs("s_acctbal"), F.lit(30.0)).alias("length"))
    u = rollup.aligned(keys, counts, ["id"], ["y", "z"])
    total = u.agg((F.sum("y") / F.sum("length")).alias("rate"))
    return u.join(F.broadcast(total)).withColumn("mu", F.col("rate") * F.col("length")).drop("rate")


_U = """k AS (SELECT s_suppkey AS id, s_nationkey AS block, greatest(abs(s_acctbal), 30.0) AS length FROM supplier),
    c AS (SELECT l_suppkey AS id, count(*) FILTER (WHERE l_returnflag = 'R' AND year(l_shipdate) BETWEEN 1995 AND 1998) AS y, count(*) FILTER (WHERE l_returnflag = 'R' AND year(l_shipdate) = 1999) AS z FROM lineitem GROUP BY 1),
    b AS (SELECT id, block, length, coalesce(y, 0) AS y, coalesce(z, 0) AS z FROM k LEFT JOIN c USING (id)),
    u AS (SELECT *, length * (SELECT sum(y) / sum(length) FROM b) AS mu FROM b),
    d AS (SELECT greatest(0.0, sum((y - mu) ** 2 - y) / sum(mu ** 2)) AS k FROM u),
    s AS (SELECT u.*, mu / (1 + k * mu) + (1 - 1 / (1 + k * mu)) * y AS eb FROM u, d)"""


def shrunk(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    k = evaluate.overdispersion(u, "y", "mu")
    return u.join(F.broadcast(k)).withColumn("eb", evaluate.shrunk(F.col("y"), F.col("mu"), F.col("k"))).drop("k")


@Q.add("overdispersion_mom", f"WITH {_U} SELECT round(k, 6) AS k FROM d")
def overdispersion_mom(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.overdispersion(units(spark, d), "y", "mu").select(F.round("k", 6).alias("k"))


@Q.add("eb_blend", f"WITH {_U} SELECT id, y, round(mu, 4) AS mu, round(eb, 4) AS eb FROM s")
def eb_blend(spark: SparkSession, d: str) -> DataFrame:
    return shrunk(spark, d).select("id", "y", F.round("mu", 4).alias("mu"), F.round("eb", 4).alias("eb"))


def _deviance_sql(y: str, mu: str) -> str:
    return f"2 * avg(CASE WHEN {y} > 0 THEN {y} * ln({y} / greatest({mu}, 1e-12)) ELSE 0 END - ({y} - greatest({mu}, 1e-12)))"


@Q.add("poisson_deviance", f"WITH {_U} SELECT round({_deviance_sql('z', 'eb / 4')}, 6) AS deviance FROM s")
def poisson_deviance(spark: SparkSession, d: str) -> DataFrame:
    return shrunk(spark, d).agg(F.round(evaluate.deviance(F.col("z"), F.col("eb") / 4), 6).alias("deviance"))


@Q.add("shape_deviance", f"WITH {_U}, f AS (SELECT sum(z) / sum(eb) AS f FROM s) SELECT round({_deviance_sql('z', '(eb * f)')}, 6) AS deviance FROM s, f")
def shape_deviance(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.shape_deviance(shrunk(spark, d), "eb", "z").select(F.round("deviance", 6).alias("deviance"))


@Q.add("eb_k_grid", f"""
    WITH {_U}, g AS (SELECT unnest({GRID}) AS k, generate_subscripts({GRID}, 1) AS i),
    t AS (SELECT g.i, g.k, {_deviance_sql('z', '((mu / (1 + g.k * mu) + (1 - 1 / (1 + g.k * mu)) * y) / 4)')} AS v FROM u, g GROUP BY g.i, g.k)
    SELECT CAST(k AS DOUBLE) AS k, round(v, 4) AS deviance FROM t ORDER BY v, i LIMIT 1""")
def eb_k_grid(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d).withColumn("z4", F.col("z") * 4)
    tried = u.select("y", "mu", "z", F.posexplode(F.array(*map(F.lit, GRID))).alias("i", "k"))
    fit = tried.groupBy("i", "k").agg(evaluate.deviance(F.col("z"), evaluate.shrunk(F.col("y"), F.col("mu"), F.col("k")) / 4).alias("v"))
    return fit.agg(F.min(F.struct("v", "i", "k")).alias("m")).select(F.col("m.k").alias("k"), F.round("m.v", 4).alias("deviance"))


_CAPTURE = """r AS (SELECT *, coalesce(sum(length) OVER (ORDER BY {score} DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length) OVER () * {share} AS budget FROM {rows}),
    t AS (SELECT z, least(1.0, greatest(0.0, (budget - before) / length)) AS take FROM r)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Units ranked by their smoothed rate in the training years: what share of the next year the top tenth of the length captures."""
    ranked = shrunk(spark, d).withColumn("density", F.col("eb") / F.col("length"))
    return evaluate.capture(ranked, "density", "z", "length", "id").select(F.round("captured", 4).alias("captured"), F.col("observed").cast("long").alias("observed"), F.round("share", 6).alias("share"))


Q.add("capture_top_share", f"""
    WITH {_U}, v AS (SELECT *, eb / length AS density FROM s), {_CAPTURE.format(score='density', share='0.1', rows='v')}
    SELECT round(sum(take * z), 4) AS captured, CAST(sum(z) AS BIGINT) AS observed, round(sum(take * z) / sum(z), 6) AS share FROM t""")(flagship)


@Q.add("decile_calibration", f"""
    WITH {_U}, r AS (SELECT *, row_number() OVER (ORDER BY eb, id) AS r, count(*) OVER () AS n FROM s)
    SELECT CAST(greatest(0, ceil(10 * CAST(r - 1 AS DOUBLE) / (n - 1)) - 1) AS INTEGER) AS decile, round(sum(eb), 4) AS predicted, CAST(sum(z) AS BIGINT) AS observed, round(sum(z) / sum(eb), 6) AS ratio FROM r GROUP BY 1""")
def decile_calibration(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.calibration(shrunk(spark, d), "eb", "z", "id")
    return out.select("decile", F.round("predicted", 4).alias("predicted"), F.col("observed").cast("long").alias("observed"), F.round("ratio", 6).alias("ratio"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.rint(F.col("c_acctbal") / 100).alias("s"), (F.col("c_mktsegment") == "BUILDING").alias("l"))


_L = "(SELECT round_even(c_acctbal / 100, 0) AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS l FROM customer)"


@Q.add("auc_rank_sum", f"""
    WITH r AS (SELECT l, avg(rn) OVER (PARTITION BY s) AS rank FROM (SELECT *, row_number() OVER (ORDER BY s) AS rn FROM {_L}))
    SELECT round((sum(rank * l) - sum(l) * (sum(l) + 1) / 2) / (sum(l) * (count(*) - sum(l))), 6) AS auc FROM r""")
def auc_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auc(_labelled(spark, d), "s", F.col("l")).select(F.round("auc", 6).alias("auc"))


@Q.add("average_precision", f"""
    WITH t AS (SELECT s, sum(l) AS p, count(*) AS n FROM {_L} GROUP BY 1), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS (ORDER BY s DESC))
    SELECT round(sum(p * tp / seen) / sum(p), 6) AS ap FROM c""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.average_precision(_labelled(spark, d), "s", F.col("l")).select(F.round("ap", 6).alias("ap"))


@Q.add("method_suite", f"""
    WITH {_U}, m AS (SELECT 'smoothed' AS method, id, length, z, eb / length AS score FROM s UNION ALL SELECT 'history', id, length, z, y / length FROM s UNION ALL SELECT 'tier', id, length, z, 4 - block % 4 FROM s),
    r AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY method ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length) OVER (PARTITION BY method) * 0.1 AS budget FROM m)
    SELECT method, round(sum(least(1.0, greatest(0.0, (budget - before) / length)) * z) / sum(z), 6) AS share FROM r GROUP BY 1""")
def method_suite(spark: SparkSession, d: str) -> DataFrame:
    s = shrunk(spark, d)
    scores = {"smoothed": F.col("eb") / F.col("length"), "history": F.col("y") / F.col("length"), "tier": 4 - F.col("block") % 4}
    out = None
    for name, score in scores.items():
        one = evaluate.capture(s.withColumn("score", score), "score", "z", "length", "id").select(F.lit(name).alias("method"), F.round("share", 6).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


@Q.add("block_bootstrap_ci")
def block_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    s = shrunk(spark, d).withColumns({"smoothed": F.col("eb") / F.col("length"), "history": F.col("y") / F.col("length")})
    return evaluate.bootstrap_capture(s, ["smoothed", "history"], "z", "length", "block", "id")


@Q.add("group_folds", """
    WITH RECURSIVE g AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS i FROM customer GROUP BY 1),
    w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, 0 AS p, CAST(NULL AS INTEGER) AS c_nationkey, CAST(NULL AS BIGINT) AS n
          UNION ALL SELECT g.i, list_transform(range(1, 6), lambda j: v.load[j] + CASE WHEN j = v.least THEN g.n ELSE 0 END), v.least, g.c_nationkey, g.n
          FROM (SELECT i, load, CAST(list_position(load, list_min(load)) AS INTEGER) AS least FROM w) v JOIN g ON g.i = v.i + 1)
    SELECT c_nationkey, n, p - 1 AS fold FROM w WHERE i > 0""")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    """Nations dealt to folds by their number of customers, the largest first, each to the lightest fold."""
    sizes = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return sizes.join(F.broadcast(evaluate.fold_of_group(sizes, "c_nationkey", 5)), "c_nationkey").select("c_nationkey", "n", "fold")


@Q.add("temporal_split")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind of hour with interactions and hour levels: each cell's multiplier, its factors and the baseline."""
    kinds = ["view", "click", "error", "purchase", "signup"]
    hour = F.hour("ts")
    light = F.when((hour < 6) | (hour > 19), "dark").when(hour.isin(6, 19), "twilight").otherwise("day")
    rows = table(spark, d, "events").select("event_type", "ts", times.day_group(F.col("ts")).alias("day_group"), hour.alias("hour"), light.alias("light"), (F.minute("ts") < 20).alias("wet"), (F.col("user_id") % 4 == 0).alias("is_ped"))
    dims = ["day_group", "hour", "light", "wet"]
    cells = rows.groupBy(*dims).agg(F.countDistinct(F.date_trunc("hour", "ts")).alias("n")).select(*dims, (F.col("n") * F.when(F.col("wet"), 1 / 3).otherwise(2 / 3)).alias("hours"))
    cells = Scratch(spark).write(rollup.cell_table(rows, cells, rows.select("event_type").distinct(), dims, "event_type", "is_ped"))
    out = models.fit_temporal(cells, "event_type", kinds, "is_ped", 1e-3).parts(cells.where("is_ped"))
    return out.select("event_type", *dims, "factors.time_of_day", "factors.day_of_week", F.col("factors.light").alias("darkness"), "factors.rain", "base", "multiplier")


def features(spark: SparkSession, d: str) -> DataFrame:
    """Parts with counts of returns, exposure and features."""
    returns = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum((F.col("l_returnflag") == "R").cast("double")).alias("y"), F.count("*").cast("double").alias("exposure"), F.avg("l_quantity").alias("quantity"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("size"), F.log1p("p_retailprice").alias("price"), F.substring("p_brand", 7, 1).alias("group"))
    return returns.join(parts, "l_partkey")


@Q.add("zscore_features", """
    SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS z_size, round((ln(1 + p_retailprice) - avg(ln(1 + p_retailprice)) OVER ()) / stddev_samp(ln(1 + p_retailprice)) OVER (), 6) AS z_price FROM part""")
def zscore_features(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.log1p("p_retailprice").alias("price"))
    return models.standardize(parts, ["size", "price"]).select("p_partkey", F.round("z_size", 6).alias("z_size"), F.round("z_price", 6).alias("z_price"))


@Q.add("poisson_glm")
def poisson_glm(spark: SparkSession, d: str) -> DataFrame:
    df = models.standardize(features(spark, d), ["size", "price", "quantity"])
    cols = ["z_size", "z_price", "z_quantity"]
    m = models.poisson_ridge(df, cols, "y", "exposure", 0.01)
    return df.select("l_partkey", F.round(F.exp(m.log_rate(cols)) * F.col("exposure"), 6).alias("mu"))


@Q.add("temporal_glm_effects")
def temporal_glm_effects(spark: SparkSession, d: str) -> DataFrame:
    from meridian.plans.q_tables import cell_counts

    cells = cell_counts(spark, d)
    cells, day = models.one_hot(cells, "day_group", ["weekday", "friday", "saturday", "sunday"], "weekday")
    cells, kind = models.one_hot(cells, "event_type", ["click", "error", "purchase", "signup", "view"], "view")
    m = models.poisson_ridge(cells, [*day, *kind], "count", "hours", 0.001)
    rated = models.multipliers(cells.withColumn("log_rate", m.log_rate([*day, *kind])), "log_rate", "event_type", "hours")
    return rated.select("event_type", "day_group", "hour", "is_ped", F.round("multiplier", 6).alias("multiplier"), F.round(m.part([*day, *kind], "day_group"), 6).alias("day_effect"))


@Q.add("monotone_gbm")
def monotone_gbm(spark: SparkSession, d: str) -> DataFrame:
    """Rounds by cross-validation over whole brands, then all rows."""
    names = ["size", "price", "quantity"]
    df = Scratch(spark).write(features(spark, d))
    dealt = evaluate.fold_of_group(df.groupBy("group").agg(F.count("*").alias("n")), "group", 5)
    rounds, _, _ = models.boosting_rounds(df.join(F.broadcast(dealt), "group"), names, "y", "exposure", "fold", ["price"])
    m = models.fit_boosted(df, names, "y", "exposure", ["price"], rounds)
    return models.predict_boosted(df, m, names).select("l_partkey", F.round("log_mu", 6).alias("log_mu"))


@Q.add("ensemble_forecast")
def ensemble_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The ensemble chosen by forecasts of unseen brands, and what each feature adds to its log rate."""
    df = Scratch(spark).write(models.standardize(features(spark, d), ["size", "price", "quantity"]))
    m = models.fit_ensemble(df, ["z_size", "z_price", "z_quantity"], "y", "exposure", "group", ["z_price"])
    told = models.explain_ensemble(models.predict_ensemble(df, m), m)
    total = F.aggregate("parts", F.col("base"), lambda s, x: s + x)
    return told.select("l_partkey", F.round("log_mu", 6).alias("log_mu"), F.round("base", 6).alias("base"), (F.abs(total - F.col("log_mu")) < 1e-9).alias("adds_up"))


@Q.add("method_benchmark")
def method_benchmark(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark).write(shrunk(spark, d).withColumns({"smoothed": F.col("eb") / F.col("length"), "history": F.col("y") / F.col("length"), "order": evaluate.tie_order(7, F.col("id"))}))
    return evaluate.benchmark(s, "smoothed", ["history"], "z", "length", "block", "order")


@Q.add("capture_gain_interval", f"""
    WITH {_U}, v AS (SELECT id, block, length, z, eb / length AS smoothed, y / length AS history FROM s), g AS (SELECT rep, block, 1 + (rep * 7 + block * 3) % 3 AS times FROM range(20) t(rep), (SELECT DISTINCT block FROM v) WHERE (rep + block) % 4 > 0),
    y AS (SELECT v.*, 'history' AS method, history AS score FROM v UNION ALL SELECT v.*, 'smoothed', smoothed FROM v),
    o AS (SELECT method, rep, id, score, length * times AS size, z * times AS got FROM y JOIN g USING (block)),
    r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY method, rep ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY method, rep) * 0.1 AS budget FROM o),
    w AS (SELECT method, rep, sum(least(1.0, greatest(0.0, (budget - before) / size)) * got) / nullif(sum(got), 0) AS c FROM r GROUP BY 1, 2)
    SELECT 'history' AS method, round(quantile_cont(a.c - b.c, 0.025), 6) AS low, round(quantile_cont(a.c - b.c, 0.975), 6) AS high FROM w a JOIN w b USING (rep) WHERE a.method = 'smoothed' AND b.method = 'history'""")
def capture_gain_interval(spark: SparkSession, d: str) -> DataFrame:
    """The interval of a gain over draws of blocks that are given."""
    s = Scratch(spark).write(shrunk(spark, d).withColumns({"smoothed": F.col("eb") / F.col("length"), "history": F.col("y") / F.col("length")}))
    blocks = s.select("block").distinct()
    draws = spark.range(20).select(F.col("id").alias("rep")).join(F.broadcast(blocks), (F.col("rep") + F.col("block")) % 4 > 0)
    draws = draws.withColumn("times", 1 + (F.col("rep") * 7 + F.col("block") * 3) % 3)
    out = evaluate.capture_gains(s, "smoothed", ["history"], "z", "length", "block", "id", draws=draws)
    return out.select("method", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _poisson_sql(u: str) -> str:
    total, term, out = 0.0, math.exp(-1.0), []
    for k in range(1, 12):
        total, term = total + term, term / k
        out.append((total, k))
    return "CASE " + " ".join(f"WHEN {u} >= {t!r} THEN {k}" for t, k in reversed(out)) + " ELSE 0 END"


@Q.add("mean_interval", f"""
    WITH t AS (SELECT rep, s_acctbal AS v, CAST(('0x' || substr(md5(s_suppkey || '|' || rep), 1, 8)) AS UBIGINT) / 4294967296.0 AS u FROM supplier, range(100) t(rep)),
    m AS (SELECT rep, sum(v * w) / sum(w) AS v FROM (SELECT rep, v, {_poisson_sql('u')} AS w FROM t) GROUP BY 1)
    SELECT round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM m""")
def mean_interval(spark: SparkSession, d: str) -> DataFrame:
    stat = lambda times: F.sum(F.col("s_acctbal") * times) / F.sum(times)
    out = evaluate.bootstrap_interval(table(spark, d, "supplier"), stat, ["s_suppkey"], 100)
    return out.select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@Q.add("temporal_gain", f"""
    WITH c AS (SELECT event_type AS g, dayofweek(ts) AS day, hour(ts) AS hour, CAST(count(*) AS DOUBLE) AS n, CAST(10 + hour(ts) % 5 AS DOUBLE) AS h, sum(value) AS p FROM events GROUP BY 1, 2, 3),
    r AS (SELECT *, sum(n) OVER (PARTITION BY g) / sum(h) OVER (PARTITION BY g) * h AS flat, sum(n) OVER (PARTITION BY g, day) / sum(h) OVER (PARTITION BY g, day) * h AS part FROM c),
    f AS (SELECT sum(n) / sum(p) AS a, sum(n) / sum(flat) AS b, sum(n) / sum(part) AS c FROM r),
    v AS (SELECT {_deviance_sql('n', '(p * a)')} AS x, {_deviance_sql('n', '(flat * b)')} AS y, {_deviance_sql('n', '(part * c)')} AS z FROM r, f)
    SELECT round(x, 5) AS deviance, round(1 - x / y, 5) AS vs_flat, round(1 - x / z, 5) AS vs_by FROM v""")
def temporal_gain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cells = e.groupBy("event_type", (F.dayofweek("ts") - 1).alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("p"))
    out = evaluate.temporal_gains(cells.withColumn("h", (10 + F.col("hour") % 5).cast("double")), "p", "n", "h", "event_type", ["day"])
    return out.select(*[F.round(c, 5).alias(c) for c in ("deviance", "vs_flat", "vs_by")])


@Q.add("benchmark_targets", """
    SELECT CAST(s_suppkey AS VARCHAR) AS method, t AS target, coalesce(CASE WHEN t = 'gain' OR s_suppkey % 2 = 0 THEN s_acctbal END >= 100, FALSE) AS met FROM supplier, (VALUES ('gain'), ('low')) v(t)""")
def benchmark_targets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    bench = s.select(F.col("s_suppkey").cast("string").alias("method"), F.col("s_acctbal").alias("gain"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("low"))
    return evaluate.targets(bench, {"gain": 100.0, "low": 100.0})


@Q.add("ensemble_blend_weight", f"""
    WITH {_U}, g AS (SELECT i, i / 10.0 AS w FROM range(11) t(i)), v AS (SELECT g.i, CAST(g.w AS DOUBLE) AS w, {_deviance_sql('z', 'exp(g.w * ln(eb / 4) + (1 - g.w) * ln(mu / 4))')} AS d FROM s, g GROUP BY g.i, g.w)
    SELECT w, round(d, 6) AS deviance FROM v ORDER BY d, i LIMIT 1""")
def ensemble_blend_weight(spark: SparkSession, d: str) -> DataFrame:
    s = shrunk(spark, d).withColumns({"a": F.ln(F.col("eb") / 4), "b": F.ln(F.col("mu") / 4)})
    return models.best_blend(s, "z", "a", "b").select("w", F.round("deviance", 6).alias("deviance"))


@Q.add("quantile_scale", f"""
    WITH t AS (SELECT quantile_cont(l_extendedprice, {POINTS}) AS q FROM lineitem)
    SELECT CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS i, round(unnest(q) + 1e-7, 2) AS q FROM t""")
def quantile_scale(spark: SparkSession, d: str) -> DataFrame:
    return scoring.quantile_table(table(spark, d, "lineitem"), "l_extendedprice").select(F.posexplode("q").alias("i", "q")).select("i", F.round(F.col("q") + 1e-7, 2).alias("q"))


_T = f"t AS (SELECT quantile_cont(p_retailprice, {POINTS}) AS q FROM part)"


@Q.add("percentile_score", f"""
    WITH {_T}, v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 20 AS v FROM lineitem), p AS (SELECT v.*, q, CAST(len(list_filter(q, lambda x: x <= v)) AS INTEGER) AS n FROM v, t)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(CASE WHEN v <= q[1] THEN 0 WHEN v >= q[1001] THEN 100 ELSE (n - 1 + (v - q[n]) / (q[n + 1] - q[n])) / 10 END, 0) AS INTEGER) AS score FROM p""")
def percentile_score(spark: SparkSession, d: str) -> DataFrame:
    q = scoring.quantile_table(table(spark, d, "part"), "p_retailprice")
    rows = table(spark, d, "lineitem").join(F.broadcast(q))  # one array of 1001 numbers
    score = F.rint(scoring.percentile_score(F.col("l_extendedprice") / 20, F.col("q"))).cast("int")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))


@Q.add("centered_factors", """
    SELECT p_partkey, round(p_size - avg(p_size) OVER (), 6) AS size, round(ln(1 + p_retailprice) - avg(ln(1 + p_retailprice)) OVER (), 6) AS price, round(avg(p_size) OVER () + avg(ln(1 + p_retailprice)) OVER (), 6) AS base FROM part""")
def centered_factors(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.log1p("p_retailprice").alias("price"))
    return scoring.centered_factors(parts, ["size", "price"]).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("size", "price", "base")])


def attribution_sql(rows: str, key: str, factors: list[str], values: str, top: int) -> str:
    """Tables up to `told` (key, baseline, factors, remainder, score) from `rows` (key, base, factors) and `values` (v), whose quantiles are the scale."""
    items = ", ".join(f"{{'k': -abs({f}), 'name': '{f}', 'v': {f}}}" for f in factors)
    points = ", ".join(f"{i}/1000.0" for i in range(1001))
    return f"""w AS (SELECT {key}, base, list_sort([{items}]) AS items FROM {rows}),
    sums AS (SELECT {key}, items, list_transform(range(0, {len(factors) + 1}), lambda i: base + coalesce(list_sum(list_transform(items[1:i], lambda x: x.v)), 0)) AS vs FROM w),
    scale AS (SELECT unnest(range(0, 1001)) AS i, unnest(quantile_cont(v, [{points}])) AS q FROM {values}),
    steps AS (SELECT q, max(i) AS i, lead(q) OVER (ORDER BY q) AS nq FROM scale GROUP BY q), ends AS (SELECT min(q) AS a, max(q) AS b FROM scale),
    pts AS (SELECT {key}, unnest(range(1, {len(factors) + 2})) AS n, unnest(vs) AS v FROM sums),
    hit AS (SELECT pts.*, CASE WHEN v <= a THEN 0.0 WHEN v >= b THEN 100.0 ELSE (i + (v - q) / (nq - q)) * 100 / 1000 END AS s FROM pts ASOF LEFT JOIN steps ON pts.v >= steps.q, ends),
    sc AS (SELECT {key}, list(s ORDER BY n) AS sc FROM hit GROUP BY ALL),
    made AS (SELECT {key}, CAST(round_even(sc[1], 0) AS INTEGER) AS baseline, CAST(round_even(sc[{len(factors) + 1}], 0) AS INTEGER) AS score,
                    list_transform(range(1, {min(top, len(factors)) + 1}), lambda i: {{'name': items[i].name, 'points': CAST(round_even(sc[i + 1] - sc[i], 0) AS INTEGER)}}) AS f FROM sc JOIN sums USING ({key})),
    told AS (SELECT {key}, baseline, CAST(to_json(f) AS VARCHAR) AS factors, CAST(score - baseline - list_sum(list_transform(f, lambda x: x.points)) AS INTEGER) AS remainder, score FROM made)"""


_PARTS = "p_size / 20.0 AS size, ln(1 + p_retailprice) AS price, length(p_name) / 10.0 AS name"
_CENTERED = "c AS (SELECT p_partkey, CAST(size - avg(size) OVER () AS DOUBLE) AS size, price - avg(price) OVER () AS price, CAST(name - avg(name) OVER () AS DOUBLE) AS name, CAST(avg(size) OVER () + avg(price) OVER () + avg(name) OVER () AS DOUBLE) AS base FROM f)"


@Q.add("factor_attribution", f"""
    WITH f AS (SELECT p_partkey, {_PARTS} FROM part), {_CENTERED}, t AS (SELECT base + size + price + name AS v FROM c),
    {attribution_sql("c", "p_partkey", ["size", "price", "name"], "t", 2)}
    SELECT p_partkey, baseline, factors, remainder, score, TRUE AS adds_up FROM told""")
def factor_attribution(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size").cast("double") / 20).alias("size"), F.log1p("p_retailprice").alias("price"), (F.length("p_name").cast("double") / 10).alias("name")
    )
    names = ["size", "price", "name"]
    c = scoring.centered_factors(parts, names).withColumn("total", F.col("base") + sum((F.col(n) for n in names), F.lit(0.0)))
    q = scoring.quantile_table(c, "total")
    told = scoring.attribute(F.col("base"), {n: F.col(n) for n in names}, F.col("q"), top=2)
    out = c.join(F.broadcast(q)).select("p_partkey", told.alias("a"))
    points = F.aggregate("a.factors", F.lit(0), lambda n, x: n + x["points"])
    return out.select("p_partkey", "a.baseline", F.to_json("a.factors").alias("factors"), "a.remainder", "a.score", (F.col("a.baseline") + points + F.col("a.remainder") == F.col("a.score")).alias("adds_up"))


@Q.add("tercile_bands", """
    WITH v AS (SELECT l_suppkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'A' AND l_suppkey % 5 > 0) AS a, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
    t AS (SELECT quantile_cont(x, 1 / 3) AS lo, quantile_cont(x, 2 / 3) AS hi FROM (SELECT a AS x FROM v UNION ALL SELECT r FROM v) WHERE x IS NOT NULL)
    SELECT l_suppkey, CASE WHEN a IS NULL THEN 'unknown' WHEN a <= lo THEN 'quiet' WHEN a <= hi THEN 'moderate' ELSE 'busy' END AS a_band, CASE WHEN r IS NULL THEN 'unknown' WHEN r <= lo THEN 'quiet' WHEN r <= hi THEN 'moderate' ELSE 'busy' END AS r_band FROM v, t""")
def tercile_bands(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg(F.when((F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 5 > 0), F.col("l_quantity"))).alias("a"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("r")
    )
    return scoring.tercile_bands(v, ["a", "r"]).select("l_suppkey", "a_band", "r_band")


@Q.add("gamma_posterior_bands")
def gamma_posterior_bands(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rate_bands(units(spark, d), "z", "length").select("id", "z", "band")


@Q.add("log_mean_exp", """
    SELECT l_suppkey, round(ln(sum(exp(l_discount * 10) * l_quantity) / sum(l_quantity)), 6) AS v FROM lineitem GROUP BY 1""")
def log_mean_exp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(scoring.log_mean_exp(F.col("l_discount") * 10, F.col("l_quantity")), 6).alias("v"))


@Q.add("frame_pack", """
    SELECT user_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY h) AS scores FROM (
      SELECT user_id, hour(ts) AS h, CAST(round_even(least(100.0, sum(value) / 10), 0) AS INTEGER) AS s FROM events GROUP BY 1, 2) GROUP BY 1""")
def frame_pack(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "hour").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)  # a sum at a half turns on the order of its addends
    sums = table(spark, d, "events").select("user_id", F.hour("ts").alias("hour"), "event_id", "value").withColumn("sum", F.sum("value").over(w))
    grid = sums.groupBy("user_id", "hour").agg((F.max_by("sum", "event_id") / 10).alias("v"))
    return scoring.frames(grid, "user_id", "v").select("user_id", F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"))
