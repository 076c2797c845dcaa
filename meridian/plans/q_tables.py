"""Named queries over ingest, joins, rollups, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meridian.functions import times
from meridian.operators import ingest, ranking, rollup, scoring
from meridian.plans.registry import Registry, table

Q = Registry()


@Q.add("hourly_rollup", """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, user_id, round(sum(value), 4) AS total,
           round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 4) AS errors, round(sum(CASE WHEN event_type LIKE 'c%' THEN value ELSE 0 END), 4) AS clicks
    FROM events GROUP BY 1, 2""")
def hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    flags = {"errors": F.col("event_type") == "error", "clicks": F.col("event_type").like("c%")}
    out = rollup.hourly_rollup(table(spark, d, "events"), "user_id", F.col("value"), flags)
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), "user_id", *[F.round(c, 4).alias(c) for c in ("total", "errors", "clicks")])


@Q.add("citywide_profile", """
    SELECT CAST(hour(ts - INTERVAL 5 HOUR) AS INTEGER) AS hour, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def citywide_profile(spark: SparkSession, d: str) -> DataFrame:
    hours = rollup.hourly_rollup(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", F.col("value"), {})
    return rollup.hour_profile(hours, "total", times.ZONE).select("hour", F.round("total", 4).alias("total"))


@Q.add("hour_profile_dense", """
    WITH g AS (SELECT user_id, h FROM (SELECT DISTINCT user_id FROM events), range(24) t(h)),
    c AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY g.h) AS profile
    FROM g LEFT JOIN c USING (user_id, h) GROUP BY user_id""")
def hour_profile_dense(spark: SparkSession, d: str) -> DataFrame:
    hours = rollup.hourly_rollup(table(spark, d, "events"), "user_id", F.lit(1), {})
    out = rollup.dense_profile(hours, "user_id", "total")
    return out.select("user_id", F.array_join(F.transform("profile", lambda x: x.cast("long").cast("string")), ",").alias("profile"))


_RULES = {
    "orders": lambda raw: {
        "source_id": F.col("o_orderkey"), "collision_id": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).otherwise("none"),
        "ts": F.col("o_orderdate"), "lat": F.col("o_totalprice") / 10000, "lon": -F.col("o_totalprice") / 5000,
        "is_ped": F.col("o_orderpriority").startswith("1"), "road": F.col("o_orderstatus"),
    },
    "events": lambda raw: {
        "source_id": F.col("event_id"), "ts": F.col("ts"), "lat": F.col("value"), "lon": F.lit(None), "is_bike": F.col("event_type") == "click", "road": F.col("event_type"),
    },
    "parts": lambda raw: {"source_id": F.col("p_partkey"), "year": F.lit(2000) + F.col("p_size") % 20, "lat": F.lit(0.0), "lon": F.lit(0.0), "cross_road": ingest.column(raw, "p_missing")},
}


def canonical(spark: SparkSession, d: str) -> DataFrame:
    return ingest.union_sources({"orders": table(spark, d, "orders"), "events": table(spark, d, "events"), "parts": table(spark, d, "part")}, _RULES)


_CANONICAL_SQL = """
    SELECT 'orders' AS source, CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS collision_id,
           CAST(year(o_orderdate) AS INTEGER) AS year, 'minute' AS time_precision, o_totalprice / 10000 AS lat, -o_totalprice / 5000 AS lon,
           starts_with(o_orderpriority, '1') AS is_ped, FALSE AS is_bike, o_orderstatus AS road FROM orders
    UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), NULL, CAST(year(ts) AS INTEGER), 'minute', value, NULL, FALSE, event_type = 'click', event_type FROM events
    UNION ALL SELECT 'parts', CAST(p_partkey AS VARCHAR), NULL, CAST(2000 + p_size % 20 AS INTEGER), 'year', 0.0, 0.0, FALSE, FALSE, NULL FROM part"""


@Q.add("canonical_union", f"SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon) FROM ({_CANONICAL_SQL})")
def canonical_union(spark: SparkSession, d: str) -> DataFrame:
    cols = ["source", "source_id", "collision_id", "year", "time_precision", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "is_ped", "is_bike", "road"]
    return canonical(spark, d).select(*cols)


@Q.add("bad_row_reasons", f"""
    SELECT source, CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing' WHEN abs(lat) < 1e-6 AND abs(lon) < 1e-6 THEN 'zero'
           WHEN NOT (lat BETWEEN 5 AND 35 AND lon BETWEEN -60 AND -10) THEN 'outside' ELSE 'kept' END AS reason, count(*) AS n
    FROM ({_CANONICAL_SQL}) GROUP BY 1, 2""")
def bad_row_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = ingest.bad_position(F.col("lat"), F.col("lon"), (-60.0, 5.0, -10.0, 35.0))
    return canonical(spark, d).groupBy("source", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@Q.add("exact_dedupe", """
    SELECT l_orderkey, arg_min(l_linenumber, (l_extendedprice, l_linenumber, l_partkey)) AS l_linenumber, round(min(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_orderkey""")
def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    out = ingest.exact_dedupe(rows, "l_orderkey", [F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")])
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))


def crashes(spark: SparkSession, d: str) -> DataFrame:
    """Events as crashes on a line, one collision_id shared by every 2000th."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("x"), (F.hash("event_type") % 997 * 1000.0).alias("y"), F.when(F.col("event_id") % 2000 == 7, "c7").alias("collision_id"),
        (F.col("event_id") % 3 == 0).alias("is_ped"), (F.col("event_id") % 7 == 0).alias("is_bike"),
        F.when(F.col("event_id") % 5 < 4, F.substring(F.lit("OCBA"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1))).alias("severity"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("l"), F.col("event_id") % 10)).alias("light_report"), F.lit(None).cast("string").alias("surface_report"),
    )


_LINKS_SQL = """
    SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id < b.event_id
      AND abs(a.value - b.value) <= 0.5 AND abs(date_diff('second', a.ts, b.ts)) <= 1800
    UNION SELECT 7, event_id FROM events WHERE event_id % 2000 = 7 AND event_id > 7"""
CLUSTERS_SQL = f"""
    WITH RECURSIVE link AS ({_LINKS_SQL}), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
    cluster AS (SELECT e.event_id AS id, coalesce(min(reach.other), e.event_id) AS cluster FROM events e LEFT JOIN reach ON reach.id = e.event_id GROUP BY e.event_id)"""


def clustered(spark: SparkSession, d: str) -> DataFrame:
    rows = crashes(spark, d)
    return ingest.cluster_events(rows, ingest.cluster_links(rows, 0.5, 1800))


@Q.add("fuzzy_dedupe_cc", CLUSTERS_SQL + " SELECT id, cluster FROM cluster")
def fuzzy_dedupe_cc(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d).select("id", "cluster")


@Q.add("cluster_merge", CLUSTERS_SQL + """
    , c AS (SELECT cluster.cluster, e.*, CASE e.event_id % 5 WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 WHEN 0 THEN 4 END AS rank,
                   CASE WHEN e.event_id % 2 = 0 THEN 'l' || CAST(e.event_id % 10 AS VARCHAR) END AS light
            FROM cluster JOIN events e ON e.event_id = cluster.id)
    SELECT cluster, arg_min(CAST(event_id AS VARCHAR), (ts, event_type, CAST(event_id AS VARCHAR))) AS source_id, bool_or(event_id % 3 = 0) AS is_ped, bool_or(event_id % 7 = 0) AS is_bike,
           CASE min(rank) WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'O' END AS severity,
           arg_min(light, (ts, event_type, CAST(event_id AS VARCHAR))) FILTER (WHERE light IS NOT NULL) AS light_report,
           count(DISTINCT event_type) AS n_sources, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS sources, count(*) AS n_rows
    FROM c GROUP BY cluster""")
def cluster_merge(spark: SparkSession, d: str) -> DataFrame:
    return ingest.merge_clusters(clustered(spark, d)).select("cluster", "source_id", "is_ped", "is_bike", "severity", "light_report", "n_sources", "sources", "n_rows")


@Q.add("source_counters", """
    SELECT l_returnflag AS source, count(*) AS n, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
           count(DISTINCT l_partkey) AS ids, count(*) - count(DISTINCT l_partkey) AS surplus FROM lineitem GROUP BY 1""")
def source_counters(spark: SparkSession, d: str) -> DataFrame:
    ids = F.countDistinct("l_partkey")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(
        F.count("*").alias("n"), F.sum((F.col("l_discount") > 0.05).cast("int")).alias("flagged"), ids.alias("ids"), (F.count("*") - ids).alias("surplus")
    )


@Q.add("trailing_window_counts", """
    SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-20' - 7 AND CAST(ts AS DATE) <= DATE '2024-01-20' GROUP BY 1""")
def trailing_window_counts(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return rollup.trailing_days(days, "day", F.lit("2024-01-20").cast("date"), 7).groupBy("event_type").agg(F.count("*").alias("n"))


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time")).agg(F.sum("value").alias("precip"))


@Q.add("wet_lag_or", """
    WITH h AS (SELECT date_trunc('hour', ts) AS t, sum(value) AS v FROM events GROUP BY 1)
    SELECT strftime(t, '%Y-%m-%d %H') AS hour, (v >= 900 OR coalesce(lag(v) OVER (ORDER BY t) >= 900, FALSE)) AS wet FROM h""")
def wet_lag_or(spark: SparkSession, d: str) -> DataFrame:
    return rollup.wet_hours(_hours(spark, d), 900.0).select(F.date_format("time", "yyyy-MM-dd HH").alias("hour"), "wet")


@Q.add("exposure_cells", """
    WITH h AS (SELECT date_trunc('hour', ts) AS t, sum(value) AS v FROM events GROUP BY 1),
    w AS (SELECT t, (v >= 900 OR coalesce(lag(v) OVER (ORDER BY t) >= 900, FALSE)) AS wet FROM h)
    SELECT CASE WHEN isodow(t) <= 4 THEN 'weekday' WHEN isodow(t) = 5 THEN 'friday' WHEN isodow(t) = 6 THEN 'saturday' ELSE 'sunday' END AS day_group,
           CAST(hour(t) AS INTEGER) AS hour, wet, count(*) AS hours FROM w GROUP BY 1, 2, 3""")
def exposure_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = rollup.exposure_cells(rollup.wet_hours(_hours(spark, d), 900.0))
    return cells.groupBy("day_group", "hour", "wet").agg(F.sum("hours").alias("hours"))


_CELLS_SQL = """
    hours AS (SELECT CASE WHEN isodow(t) <= 4 THEN 'weekday' WHEN isodow(t) = 5 THEN 'friday' WHEN isodow(t) = 6 THEN 'saturday' ELSE 'sunday' END AS day_group,
                     CAST(hour(t) AS INTEGER) AS hour, count(*) AS hours FROM (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events) GROUP BY 1, 2),
    grid AS (SELECT * FROM hours, (SELECT DISTINCT event_type FROM events), (VALUES (FALSE), (TRUE)) f(is_ped)),
    n AS (SELECT CASE WHEN isodow(ts) <= 4 THEN 'weekday' WHEN isodow(ts) = 5 THEN 'friday' WHEN isodow(ts) = 6 THEN 'saturday' ELSE 'sunday' END AS day_group,
                 CAST(hour(ts) AS INTEGER) AS hour, event_type, user_id % 4 = 0 AS is_ped, count(*) AS count FROM events GROUP BY 1, 2, 3, 4),
    cells AS (SELECT day_group, hour, event_type, is_ped, hours, coalesce(count, 0) AS count FROM grid LEFT JOIN n USING (day_group, hour, event_type, is_ped))"""


def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(times.day_group(F.col("ts")).alias("day_group"), F.hour("ts").alias("hour"), "event_type", (F.col("user_id") % 4 == 0).alias("is_ped"))
    cells = _hours(spark, d).select(times.day_group(F.col("time")).alias("day_group"), F.hour("time").alias("hour")).groupBy("day_group", "hour").agg(F.count("*").alias("hours"))
    return rollup.cell_table(events, cells, events.select("event_type").distinct(), ["day_group", "hour"], "event_type", "is_ped")


@Q.add("dense_cell_counts", f"WITH {_CELLS_SQL} SELECT * FROM cells")
def dense_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return cell_counts(spark, d).select("day_group", "hour", "event_type", "is_ped", "hours", "count")


@Q.add("flat_rate_baseline", f"WITH {_CELLS_SQL} SELECT event_type, is_ped, round(CAST(sum(count) AS DOUBLE) / CAST(sum(hours) AS DOUBLE), 6) AS rate FROM cells GROUP BY 1, 2")
def flat_rate_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rollup.flat_rates(cell_counts(spark, d), ["event_type", "is_ped"]).withColumn("rate", F.round("rate", 6))


@Q.add("collapsed_cells", f"WITH {_CELLS_SQL} SELECT day_group, is_ped, CAST(sum(count) AS BIGINT) AS count, CAST(sum(hours) AS BIGINT) AS hours FROM cells GROUP BY 1, 2")
def collapsed_cells(spark: SparkSession, d: str) -> DataFrame:
    return rollup.collapse(cell_counts(spark, d), ["day_group", "is_ped"])


@Q.add("hour_lookup_join", """
    WITH h AS (SELECT date_trunc('hour', ts) AS t, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT event_id, round(v, 4) AS rain FROM events JOIN h ON date_trunc('hour', ts) = t""")
def hour_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("time", times.utc_hour(F.col("ts").cast("timestamp")))
    hours = events.where("event_type = 'view'").groupBy("time").agg(F.round(F.sum("value"), 4).alias("rain"))
    return events.join(hours, "time").select("event_id", "rain")


@Q.add("window_counts_by_year", """
    SELECT s_suppkey, coalesce(n, 0) AS total FROM supplier LEFT JOIN
      (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 1998 AND l_returnflag = 'R' GROUP BY 1) ON l_suppkey = s_suppkey""")
def window_counts_by_year(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("year"), "l_returnflag")
    return rollup.window_counts(items, table(spark, d, "supplier"), "s_suppkey", (1995, 1998), F.lit(1), F.col("l_returnflag") == "R")


@Q.add("group_median_impute", """
    SELECT p_partkey, round(coalesce(v, median(v) OVER (PARTITION BY p_brand), 0.0), 4) AS size
    FROM (SELECT p_partkey, p_brand, CAST(nullif(p_size % 7, 0) AS DOUBLE) AS v FROM part)""")
def group_median_impute(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", F.nullif(F.col("p_size") % 7, F.lit(0)).cast("double").alias("size"))
    return rollup.fill_group_median(parts, "p_brand", ["size"]).select("p_partkey", F.round("size", 4).alias("size"))


@Q.add("day_part_crosstab", """
    SELECT user_id, count(*) FILTER (WHERE p = 'night') AS night, count(*) FILTER (WHERE p = 'morning') AS morning, count(*) FILTER (WHERE p = 'afternoon') AS afternoon, count(*) FILTER (WHERE p = 'evening') AS evening
    FROM (SELECT user_id, CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS p FROM events) GROUP BY 1""")
def day_part_crosstab(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", times.day_part(F.hour("ts")).alias("p"))
    return rollup.crosstab(events, events.select("user_id").distinct(), "user_id", "p", list(times.DAY_PARTS))


@Q.add("pivot_mean", """
    SELECT l_suppkey, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 4) AS A, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 4) AS N, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 4) AS R
    FROM lineitem GROUP BY 1""")
def pivot_mean(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).avg("l_quantity")
    return out.select("l_suppkey", *[F.round(c, 4).alias(c) for c in "ANR"])


@Q.add("weighted_blend", """
    SELECT l_suppkey, round(CASE WHEN a IS NULL AND r IS NULL THEN NULL ELSE (coalesce(a * 5, 0) + coalesce(r * 2, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 5 END + CASE WHEN r IS NULL THEN 0 ELSE 2 END) END, 4) AS blend
    FROM (SELECT l_suppkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'A' AND l_suppkey % 3 > 0) AS a, avg(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_suppkey % 4 > 0) AS r FROM lineitem GROUP BY 1)""")
def weighted_blend(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda flag, n: F.avg(F.when((F.col("l_returnflag") == flag) & (F.col("l_suppkey") % n > 0), F.col("l_quantity")))
    out = table(spark, d, "lineitem").groupBy("l_suppkey").agg(mean("A", 3).alias("a"), mean("R", 4).alias("r"))
    return out.select("l_suppkey", F.round(rollup.known_mean([(F.col("a"), 5.0), (F.col("r"), 2.0)]), 4).alias("blend"))


@Q.add("lit_share_threshold", """
    SELECT p_brand, round(CASE WHEN known > 0 AND known >= 0.5 * total THEN yes / known END, 6) AS share FROM (
      SELECT p_brand, sum(p_retailprice) AS total, sum(CASE WHEN s >= 0 THEN p_retailprice ELSE 0 END) AS known, sum(CASE WHEN s = 1 THEN p_retailprice ELSE 0 END) AS yes
      FROM (SELECT *, CASE WHEN p_size % 10 < 5 THEN -1 ELSE p_size % 2 END AS s FROM part) GROUP BY 1)""")
def lit_share_threshold(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("s", F.when(F.col("p_size") % 10 < 5, -1).otherwise(F.col("p_size") % 2))
    return rollup.share_with_evidence(parts, "p_brand", "p_retailprice", "s").withColumn("share", F.round("share", 6))


@Q.add("period_day_part_rates", """
    SELECT s_suppkey, round((a / 6 * 6 + c / 5 * 2) / 8, 1) AS night, round((b / 4 * 4 + m / 5 * 2) / 6, 1) AS morning, round((m / 5 * 3 + e / 4 * 3) / 6, 1) AS afternoon, round((e / 4 * 1 + c / 5 * 3) / 4, 1) AS evening
    FROM (SELECT s_suppkey, s_acctbal AS a, s_acctbal * 2 AS b, s_acctbal * 3 AS m, s_acctbal * 4 AS e, s_acctbal * 5 AS c FROM supplier)""")
def period_day_part_rates(spark: SparkSession, d: str) -> DataFrame:
    periods = {"a": (0, 6), "b": (6, 10), "m": (10, 15), "e": (15, 19), "c": (19, 24)}
    volumes = table(spark, d, "supplier").select("s_suppkey", *[(F.col("s_acctbal") * (i + 1)).alias(c) for i, c in enumerate(periods)])
    tenths = lambda c: F.round(F.col(c) * 10) / 10  # noqa: E731  # F.round(c, 1) goes by the decimal digits of a double, which may lie just below a half
    return rollup.day_part_rates(volumes, periods).select("s_suppkey", *[tenths(p).alias(p) for p in times.DAY_PARTS])


@Q.add("histogram_median", """
    SELECT event_type, min(s) AS median FROM (
      SELECT event_type, s, sum(n) OVER (PARTITION BY event_type ORDER BY s) AS c, sum(n) OVER (PARTITION BY event_type) AS t
      FROM (SELECT event_type, user_id % 101 AS s, count(*) AS n FROM events GROUP BY 1, 2)) WHERE 2 * c >= t GROUP BY 1""")
def histogram_median(spark: SparkSession, d: str) -> DataFrame:
    return rollup.histogram_median(table(spark, d, "events").withColumn("s", F.col("user_id") % 101), "event_type", "s")


@Q.add("category_summary", """
    SELECT event_type, count(*) AS n, CAST(sum(user_id % 5) AS BIGINT) AS confirmations FROM events WHERE ts + INTERVAL 14 DAY > TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1""")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    live = table(spark, d, "events").where(F.col("ts") + F.expr("interval 14 days") > now)
    out = live.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("user_id") % 5).alias("confirmations"))
    return out.orderBy(F.desc("n"), F.desc("confirmations"), "event_type")


@Q.add("running_rank", """
    SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, round(coalesce(sum(c_acctbal) OVER (ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS before FROM customer""")
def running_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    out = ranking.running(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], {"before": F.col("c_acctbal")}, "rank")
    return out.select("c_custkey", F.col("rank").cast("long").alias("rank"), F.round("before", 2).alias("before"))


@Q.add("quantile_cut", """
    SELECT c_custkey, CAST(greatest(0, ceil(10 * CAST(r - 1 AS DOUBLE) / (n - 1)) - 1) AS INTEGER) AS decile
    FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer)""")
def quantile_cut(spark: SparkSession, d: str) -> DataFrame:
    return ranking.deciles(table(spark, d, "customer"), [F.asc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "decile")


@Q.add("top_k_per_group", """
    SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3""")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_nationkey", "c_custkey")


@Q.add("trip_log_newest", """
    SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""")
def trip_log(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 20").select("event_id")


@Q.add("bbox_topk", """
    SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 8000 AND c_nationkey BETWEEN 3 AND 15 ORDER BY c_acctbal DESC, c_custkey LIMIT 300""")
def bbox_topk(spark: SparkSession, d: str) -> DataFrame:
    box = F.col("c_acctbal").between(1000, 8000) & F.col("c_nationkey").between(3, 15)
    return table(spark, d, "customer").where(box).select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(300)


@Q.add("hotspot_top5pct", """
    WITH n AS (SELECT user_id, max(CAST(value AS INTEGER) % 101) AS s FROM events GROUP BY 1),
    t AS (SELECT greatest(75, min(s)) AS bar FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS r, count(*) OVER () AS c FROM n) WHERE r <= ceil(0.05 * c))
    SELECT user_id, s FROM n, t WHERE s >= bar""")
def hotspot_top5pct(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "events").groupBy("user_id").agg(F.max(F.rint("value").cast("int") % 101).alias("s"))  # halves to even
    return scoring.hotspots(nodes, "s").select("user_id", "s")


@Q.add("semi_and_anti_joins", """
    SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders""")
def semi_and_anti_joins(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey")
    a = c.join(orders, "c_custkey", "left_semi").agg(F.count("*").alias("with_orders"))
    return a.join(F.broadcast(c.join(orders, "c_custkey", "left_anti").agg(F.count("*").alias("without_orders"))))  # one row each


@Q.add("set_shared", """
    SELECT user_id, array_to_string(list_sort(list_intersect(list(DISTINCT t) FILTER (WHERE v >= 100), list(DISTINCT t) FILTER (WHERE v < 20))), ',') AS names
    FROM (SELECT user_id, event_type AS t, value AS v FROM events) GROUP BY 1""")
def set_shared(spark: SparkSession, d: str) -> DataFrame:
    from meridian.operators.routing import shared_names

    a, b = (F.collect_set(F.when(c, F.col("event_type"))) for c in (F.col("value") >= 100, F.col("value") < 20))
    known = F.size(a) > 0  # who has no first list has nothing to share, which is null in SQL and not an empty list
    return table(spark, d, "events").groupBy("user_id").agg(F.when(known, F.array_join(shared_names(a, b), ",")).alias("names"))


@Q.add("set_avoided", """
    SELECT user_id, array_to_string(list_sort(list_filter(coalesce(list(DISTINCT t) FILTER (WHERE v >= 100), []), lambda x: NOT list_contains(coalesce(list(DISTINCT t) FILTER (WHERE v < 20), []), x))), ',') AS names
    FROM (SELECT user_id, event_type AS t, value AS v FROM events) GROUP BY 1""")
def set_avoided(spark: SparkSession, d: str) -> DataFrame:
    from meridian.operators.routing import avoided_names

    a, b = (F.collect_set(F.when(c, F.col("event_type"))) for c in (F.col("value") >= 100, F.col("value") < 20))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(avoided_names(a, b), ",").alias("names"))


@Q.add("alert_islands", """
    WITH s AS (SELECT l_suppkey AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS pos, 'street ' || CAST(l_partkey % 3 AS VARCHAR) AS name,
                      l_quantity AS length, CAST(60 + l_partkey % 40 AS INTEGER) AS score FROM lineitem),
    p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, lag(name) OVER w AS pn, lag(score) OVER w AS ps FROM s WINDOW w AS (PARTITION BY path ORDER BY pos)),
    h AS (SELECT *, sum(CASE WHEN pn = name AND ps >= 90 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY pos) AS run FROM p WHERE score >= 90),
    r AS (SELECT path, run, min(a) AS a, max(a + length) AS b, max(score) AS score, any_value(name) AS name FROM h GROUP BY 1, 2),
    g AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY path ORDER BY a) > 100 THEN 1 WHEN lag(b) OVER (PARTITION BY path ORDER BY a) IS NULL THEN 1 ELSE 0 END AS new FROM r),
    k AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY a) AS alert FROM g),
    f AS (SELECT path, alert, name, min(a) AS fa FROM k GROUP BY 1, 2, 3),
    n AS (SELECT path, alert, string_agg(name, ',' ORDER BY fa) AS names FROM f GROUP BY 1, 2)
    SELECT path, CAST(alert AS BIGINT) AS alert, round(min(a), 4) AS start, round(max(b), 4) AS "end", any_value(names) AS names, max(score) AS score, count(*) AS stretches
    FROM k JOIN n USING (path, alert) GROUP BY path, alert""")
def alert_islands(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    steps = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("path"), F.row_number().over(w).alias("pos"), F.concat(F.lit("street "), F.col("l_partkey") % 3).alias("name"),
        F.col("l_quantity").alias("length"), (60 + F.col("l_partkey") % 40).cast("int").alias("score"),
    )
    out = rollup.merge_alerts(steps, "path")
    return out.select("path", "alert", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.array_join("names", ",").alias("names"), "score", "stretches")


@Q.add("traversal_offsets", """
    SELECT l_suppkey, pos, round(coalesce(sum(t) OVER (PARTITION BY l_suppkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + t / 2, 4) AS at
    FROM (SELECT l_suppkey, l_quantity AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS pos FROM lineitem)""")
def traversal_offsets(spark: SparkSession, d: str) -> DataFrame:
    from meridian.operators.routing import traversal_offsets as offsets

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    steps = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("t"), F.row_number().over(w).cast("long").alias("pos"))
    return offsets(steps, "l_suppkey", "t").select("l_suppkey", "pos", F.round("at", 4).alias("at"))
