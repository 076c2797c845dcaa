"""Named queries over state in time and over versions of tables: the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meridian.plans.q_tables import CLUSTERS_SQL, crashes
from meridian.plans.registry import Registry, table
from meridian.plans.scratch import Scratch
from meridian.sources import readers, sinks, store
from meridian.streaming import late, live, state

Q = Registry()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@Q.add("ttl_upsert_state", """
    WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR lag(ts) OVER w + INTERVAL 6 HOUR <= ts THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM g),
    t AS (SELECT user_id, event_type, run, min(ts) AS a, max(ts) AS b, count(*) AS confirmations FROM r GROUP BY 1, 2, 3)
    SELECT user_id, event_type, strftime(a, '%Y-%m-%d %H:%M:%S') AS created, strftime(b + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS expires, confirmations FROM t QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY run DESC) = 1""")
def ttl_upsert_state(spark: SparkSession, d: str) -> DataFrame:
    out = state.upsert_reports(_events(spark, d), ["user_id", "event_type"], F.expr("interval 6 hours"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", "event_type", at("created_at").alias("created"), at("expires_at").alias("expires"), "confirmations")


@Q.add("throttle_accepts", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    n AS (SELECT a.user_id, a.r, min(b.r) AS next FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.ts >= a.ts + INTERVAL 1 HOUR GROUP BY 1, 2),
    t AS (SELECT user_id, CAST(1 AS BIGINT) AS r FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT n.user_id, n.next FROM t JOIN n USING (user_id, r) WHERE n.next IS NOT NULL)
    SELECT event_id FROM t JOIN e USING (user_id, r)""")
def throttle_accepts(spark: SparkSession, d: str) -> DataFrame:
    return state.throttle(_events(spark, d), "user_id", 3600.0)


@Q.add("sliding_limit", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT user_id, n, event_id, [t] AS kept, TRUE AS ok FROM e WHERE n = 1
          UNION ALL SELECT user_id, n, event_id, CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END, len(kept) < 2
          FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(w.kept, lambda x: e.t - x <= 86400) AS kept FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
    SELECT event_id FROM w WHERE ok""")
def sliding_limit(spark: SparkSession, d: str) -> DataFrame:
    return state.sliding_limit(_events(spark, d), "user_id", 86_400.0, 2)


@Q.add("session_updates", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, event_type = 'signup' AS opens, value > 30 AS outside,
             CASE event_type WHEN 'purchase' THEN 'ended' WHEN 'click' THEN 'arrived' WHEN 'error' THEN 'walking' END AS st, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS expires FROM events GROUP BY 1
          UNION ALL SELECT user_id, n, event_id, outcome, CASE outcome WHEN 'opened' THEN 'walking' WHEN 'taken' THEN coalesce(st, status) WHEN 'missing' THEN NULL ELSE status END,
            CASE WHEN outcome = 'taken' THEN t WHEN outcome NOT IN ('opened', 'missing') THEN last END, CASE WHEN outcome IN ('opened', 'taken') THEN t + 86400 WHEN outcome <> 'missing' THEN expires END
          FROM (SELECT e.*, w.status, w.last, w.expires, CASE WHEN w.expires IS NULL OR w.expires <= t THEN CASE WHEN opens THEN 'opened' ELSE 'missing' END WHEN status = 'ended' THEN 'ended' WHEN outside THEN 'outside'
                  WHEN (st IS NULL OR st = status) AND last IS NOT NULL AND t - last < 14400 THEN 'throttled' ELSE 'taken' END AS outcome FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
    SELECT event_id, outcome, status, CAST(floor(expires) AS BIGINT) AS expires FROM w WHERE n > 0""")
def session_updates(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.expr("CASE event_type WHEN 'purchase' THEN 'ended' WHEN 'click' THEN 'arrived' WHEN 'error' THEN 'walking' END")
    e = _events(spark, d).select("event_id", "ts", "user_id", (F.col("event_type") == "signup").alias("opens"), kinds.alias("status"), (F.col("value") > 30).alias("outside"))
    return live.session_updates(e, "user_id", 14_400.0, 86_400.0).withColumn("expires", F.floor("expires"))


@Q.add("due_alerts", """
    WITH RECURSIVE a AS (SELECT s_nationkey AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS alert, abs(s_acctbal) / 20 AS start FROM supplier),
    c AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, alert FROM events JOIN a ON path = user_id % 25 AND value * 10 >= start - 60 AND value * 10 < start + 150),
    w AS (SELECT user_id, CAST('-Infinity' AS DOUBLE) AS last, CAST([] AS BIGINT[]) AS spoken, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS alert FROM c GROUP BY 1
          UNION ALL SELECT user_id, m.t, list_append(spoken, m.alert), m.event_id, m.alert
          FROM (SELECT w.user_id, w.spoken, min({'t': c.t, 'event_id': c.event_id, 'alert': c.alert}) AS m FROM w JOIN c ON c.user_id = w.user_id AND c.t >= w.last + 86400 AND NOT list_contains(w.spoken, c.alert) GROUP BY ALL))
    SELECT event_id, alert FROM w WHERE event_id IS NOT NULL""")
def due_alerts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")  # the alerts of one path
    start = F.abs("s_acctbal") / 20
    alerts = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("path"), F.row_number().over(w).cast("long").alias("alert"), start.alias("start"), (start + 150).alias("end"))
    positions = _events(spark, d).select("event_id", "ts", "user_id", (F.col("user_id") % 25).alias("path"), (F.col("value") * 10).alias("along"))
    return live.due_alerts(positions, alerts, "user_id", gap=86_400.0, life=40 * 86_400.0)


@Q.add("session_window_6h", """
    WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR lag(ts) OVER w + INTERVAL 6 HOUR < ts THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM r GROUP BY user_id, run""")
def session_window_6h(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return state.sessions(_events(spark, d), "user_id").select("user_id", at("start").alias("start"), at("end").alias("end"), "n")


@Q.add("asof_max_age", """
    WITH f AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    a AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'view')
    SELECT a.event_id, CASE WHEN epoch_us(a.ts) - epoch_us(f.ts) <= 86400000000 THEN f.value END AS value FROM a ASOF LEFT JOIN f ON a.user_id = f.user_id AND a.ts >= f.ts""")
def asof_max_age(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return state.as_of(e.where("event_type <> 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value"), ["user_id"], "value", 86_400).select("event_id", "value")


@Q.add("daily_cap", """
    SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2""")
def daily_cap(spark: SparkSession, d: str) -> DataFrame:
    return state.daily_cap(_events(spark, d), "user_id", 2).select("event_id")


@Q.add("orphan_check", "SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    return sinks.orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey").agg(F.count("*").alias("orphans"))


@Q.add("checked_update", """
    SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 AND c_nationkey < 10 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer""")
def checked_update(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    updates = rows.where("c_custkey % 3 = 0").withColumns({"c_acctbal": F.col("c_acctbal") + 1, "expected": F.when(F.col("c_nationkey") < 10, F.col("c_nationkey")).otherwise(-1)})
    return sinks.merge_checked(rows, updates, "c_custkey", "c_nationkey")


@Q.add("risk_grid_unpivot", """
    SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(count(*) AS INTEGER) AS score FROM events GROUP BY 1, 2
    UNION ALL SELECT user_id, CAST(h AS INTEGER), 0 FROM (SELECT DISTINCT user_id FROM events), range(24) t(h) WHERE (user_id, h) NOT IN (SELECT (user_id, hour(ts)) FROM events)""")
def risk_grid_unpivot(spark: SparkSession, d: str) -> DataFrame:
    from meridian.operators import rollup, scoring

    hours = rollup.hourly_rollup(_events(spark, d), "user_id", F.lit(1), {})
    packed = rollup.dense_profile(hours, "user_id", "total").select("user_id", F.transform("profile", lambda x: x.cast("int")).alias("scores"))
    return scoring.unpack_frames(packed, "user_id")


@Q.add("check_in_due", """
    WITH s AS (SELECT event_id, count(*) AS n FROM (SELECT event_id - 1 AS event_id FROM events WHERE event_type = 'error') GROUP BY 1)
    SELECT event_id, strftime(ts + to_microseconds(CAST(floor(value) AS BIGINT) * 1000000) + INTERVAL 10 MINUTE * (1 + coalesce(n, 0)), '%Y-%m-%d %H:%M:%S') AS due_at,
           event_type <> 'signup' AND ts + to_microseconds(CAST(floor(value) AS BIGINT) * 1000000) + INTERVAL 10 MINUTE * (1 + coalesce(n, 0)) <= TIMESTAMP '2024-01-15 00:00:00' AS due FROM events LEFT JOIN s USING (event_id)""")
def check_in_due(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    trips = e.select(F.col("event_id").alias("trip"), F.col("ts").alias("start"), F.floor("value").alias("eta_s"), (F.col("event_type") == "signup").alias("cancelled"))
    snoozes = e.where("event_type = 'error'").select((F.col("event_id") - 1).alias("trip"))
    out = state.check_ins(trips, snoozes, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return out.select(F.col("trip").alias("event_id"), F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("due_at"), "due")


@Q.add("weather_hours", """
    WITH h AS (SELECT date_trunc('hour', ts) AS local, max(value) AS precip FROM events GROUP BY 1)
    SELECT strftime(local + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS time, precip FROM h""")
def weather_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hourly maxima on a winter's clock as instants."""
    local = _events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("time")).agg(F.max("value").alias("precip"))
    return readers.hourly_weather(local).select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "precip")


@Q.add("late_duplicates", CLUSTERS_SQL + " SELECT id, cluster FROM cluster")
def late_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of duplicates from a stream of all crashes, a quarter of the time a batch, whose links go into a store."""
    rows = crashes(spark, d).select("id", "x", "y", "ts", "collision_id")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    scratch = Scratch(spark)
    quarter = F.when(F.lit(last == first), 0).otherwise(F.least(F.lit(3), F.floor(4 * (F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first))))))
    for i in range(4):
        rows.where(quarter == i).coalesce(1).write.parquet(f"{scratch.root}/in/{i}")
    source = late.stateful(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{scratch.root}/in")
    links = late.stream_links(source.withWatermark("ts", "1 hour"), 0.5, 1800, tile=16, block=48, chain=True)
    clusters = store.Store(spark, f"{scratch.root}/clusters", late.CLUSTERS)
    sink = links.writeStream.foreachBatch(late.link_sink(clusters)).trigger(availableNow=True)
    sink.option("checkpointLocation", f"{scratch.root}/stream").start().awaitTermination()
    return rows.select("id").join(clusters.read().select("id", "cluster"), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


@Q.add("refreshed_rollup", """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def refreshed_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Hours by user, one kind of event after another, each of which adds to old hours; every batch comes twice."""
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:00")
    rows = _events(spark, d).select(hour.alias("hour"), "user_id", "event_type", F.lit(1).cast("long").alias("n"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    held = store.Store(spark, f"{Scratch(spark).root}/rollup", "hour string, user_id long, n long, cents long")
    kinds = sorted(r[0] for r in rows.select("event_type").distinct().collect())
    for batch, kind in enumerate(kinds):
        for _ in range(2):
            store.refresh(held, rows.where(F.col("event_type") == kind), batch, ["hour", "user_id"], ["n", "cents"], F.substring("hour", 1, 10))
    return held.read().drop("part")


@Q.add("replayed_upserts", """
    SELECT c_custkey, c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 100 ELSE 0 END AS c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS stamp FROM customer""")
def replayed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Customers inserted, a third changed under the right stamp, all others under a wrong one, and the batches sent again."""
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    held = store.Store(spark, f"{Scratch(spark).root}/customers", "c_custkey long, c_nationkey int, stamp long")
    new = rows.withColumns({"stamp": F.lit(1).cast("long"), "expected": F.lit(None).cast("long")})
    right = F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(7).cast("long")
    changed = rows.select("c_custkey", (F.col("c_nationkey") + 100).alias("c_nationkey"), F.lit(2).cast("long").alias("stamp"), right.alias("expected"))
    for batch, changes in ((0, new), (1, changed), (1, new), (0, changed)):
        store.upsert(held, changes, batch, ["c_custkey"], 4, "stamp")
    return held.read().drop("part")
