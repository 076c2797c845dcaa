"""Named queries over safety signals, trips and the answers the library gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meridian.functions import text, times
from meridian.operators import products, routing, safety, scoring, spatial, trips
from meridian.plans.q_models import attribution_sql
from meridian.plans.q_space import _CHOSEN, points
from meridian.plans.registry import Registry, table

Q = Registry()
NOW = "2024-01-31 08:30:00"

_OFFENCE = "CASE event_type WHEN 'click' THEN 'Robbery' WHEN 'view' THEN 'Simple Assault' WHEN 'error' THEN 'Aggravated Assault' ELSE 'Theft' END"
_PLACE = "CASE event_id % 4 WHEN 0 THEN 'APARTMENT' WHEN 1 THEN 'STREET' WHEN 2 THEN 'PARK' END"


def incidents(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).cast("long")
    raw = table(spark, d, "events").select(
        F.expr(_OFFENCE).alias("offense"), F.expr(_PLACE).alias("place"), F.when(F.col("event_id") % 9 > 0, ms).alias("epoch_ms"), (F.col("value") / 10).alias("lat"), F.lit(-10.0).alias("lon")
    )
    return safety.public_incidents(raw, (-20.0, 5.0, 0.0, 30.0))


_INCIDENTS = f"""i AS (SELECT CASE {_OFFENCE} WHEN 'Robbery' THEN 'Robbery' WHEN 'Simple Assault' THEN 'Simple assault' ELSE 'Aggravated assault' END AS category, ts - INTERVAL 5 HOUR AS local
    FROM events WHERE {_OFFENCE} <> 'Theft' AND coalesce({_PLACE} <> 'APARTMENT', TRUE) AND event_id % 9 > 0 AND value / 10 BETWEEN 5 AND 30)"""


@Q.add("public_incidents", f"""
    WITH {_INCIDENTS} SELECT category, CASE WHEN hour(local) >= 22 OR hour(local) < 6 THEN 'night' WHEN hour(local) < 12 THEN 'morning' WHEN hour(local) < 18 THEN 'afternoon' ELSE 'evening' END AS day_part, count(*) AS n FROM i GROUP BY 1, 2""")
def public_incidents(spark: SparkSession, d: str) -> DataFrame:
    return incidents(spark, d).groupBy("category", "day_part").agg(F.count("*").alias("n"))


@Q.add("incident_window", f"""
    WITH {_INCIDENTS}, e AS (SELECT max(CAST(local AS DATE)) AS last FROM i)
    SELECT category, count(*) AS n FROM i, e WHERE CAST(local AS DATE) > last - 14 AND CAST(local AS DATE) <= last GROUP BY 1""")
def incident_window(spark: SparkSession, d: str) -> DataFrame:
    from meridian.operators.rollup import trailing_days

    i = incidents(spark, d)
    end = i.agg(F.max("local_day")).first()[0]
    return trailing_days(i, "local_day", F.lit(end), 14).groupBy("category").agg(F.count("*").alias("n"))


@Q.add("help_place_kinds", """
    SELECT kind, name, count(*) AS n FROM (
      SELECT CASE p_size % 6 WHEN 0 THEN 'police' WHEN 1 THEN 'fire' WHEN 2 THEN 'hospital' WHEN 3 THEN CASE WHEN p_brand LIKE '%1%' THEN 'station' END END AS kind,
             coalesce(nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_type END), ''), CASE p_size % 6 WHEN 0 THEN 'Police station' WHEN 1 THEN 'Fire station' WHEN 2 THEN 'Hospital' ELSE 'Rail station' END) AS name FROM part)
    WHERE kind IS NOT NULL GROUP BY 1, 2""")
def help_place_kinds(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").select(
        F.expr("CASE p_size % 6 WHEN 0 THEN 'police' WHEN 1 THEN 'fire_station' WHEN 2 THEN 'hospital' END").alias("amenity"), F.when(F.col("p_size") % 6 == 3, "station").alias("railway"),
        F.lower("p_brand").alias("network"), F.lit(None).cast("string").alias("operator"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise(F.col("p_type")).alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
    )
    return safety.help_places(raw, ["1"]).groupBy("kind", "name").agg(F.count("*").alias("n"))


@Q.add("thin_points", """
    WITH RECURSIVE p AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    w AS (SELECT label, n, [{'id': id, 'x': x, 'y': y}] AS kept FROM p WHERE n = 1
          UNION ALL SELECT p.label, p.n, CASE WHEN len(list_filter(w.kept, lambda k: sqrt((k.x - p.x) ** 2 + (k.y - p.y) ** 2) <= 30)) = 0 THEN list_append(w.kept, {'id': p.id, 'x': p.x, 'y': p.y}) ELSE w.kept END
          FROM w JOIN p ON p.label IS NOT DISTINCT FROM w.label AND p.n = w.n + 1)
    SELECT unnest(kept).id AS id FROM w QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC) = 1""")
def thin_points(spark: SparkSession, d: str) -> DataFrame:
    return safety.thin_points(points(spark, d), 30.0, ["w"]).select("id")


@Q.add("edge_lighting", """
    SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size % 3 WHEN p_size % 5 < 2 THEN p_size % 5 WHEN p_size % 7 = 0 THEN 1 ELSE -1 END AS lit FROM part""")
def edge_lighting(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda n: F.when(F.col("p_size") % n < 2, F.col("p_size") % n).otherwise(-1)
    return table(spark, d, "part").select("p_partkey", safety.edge_lighting(tag(3), tag(5), F.col("p_size") % 7 == 0).alias("lit"))


def travel(spark: SparkSession, d: str) -> DataFrame:
    """Events as trips between five places, by type and value."""
    x = lambda c: F.pmod(F.hash(c), F.lit(5)) * 1000.0
    return table(spark, d, "events").select(
        F.col("user_id").alias("user"), F.col("event_id").alias("trip"), F.col("ts").cast("timestamp").alias("at"), x("event_type").alias("x1"), (F.floor(F.col("value")) % 2 * 1000.0).alias("y1"),
        F.lit(9000.0).alias("x2"), (F.floor(F.col("value")) % 3 * 1000.0).alias("y2"),
    )


@Q.add("routine_mining")
def routine_mining(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return trips.routines(trips.place_clusters(travel(spark, d)), now).select("user", "start", "end", "trips", F.round("score", 6).alias("score"))


@Q.add("routine_pairs", f"""
    WITH t AS (SELECT user_id, event_type, floor(value) % 2 AS a, floor(value) % 3 AS b, ts,
        abs((hour(ts) + minute(ts) / 60) - 8.5) AS g FROM events),
    w AS (SELECT *, greatest(0.0, least(1.0, (3 - least(g, 24 - g)) / 2)) AS h, CASE WHEN isodow(ts) = 3 THEN 1.0 WHEN isodow(ts) < 6 THEN 0.6 ELSE 0.2 END * pow(0.5, date_diff('second', ts, TIMESTAMP '{NOW}') / 86400.0 / 14) AS r FROM t)
    SELECT user_id, event_type, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, count(*) AS trips, round(sum(h * r), 5) AS score FROM w WHERE h > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND sum(h * r) >= 0.15""")
def routine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Routines between named places, without the step that finds places."""
    base = table(spark, d, "events").select(
        F.struct("user_id", "event_type", (F.floor("value") % 2).alias("a"), (F.floor("value") % 3).alias("b")).alias("user"), F.col("event_id").alias("trip"), F.col("ts").cast("timestamp").alias("at"),
        F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"),
    )
    return trips.routines(base, F.lit(NOW).cast("timestamp")).select("user.*", "trips", F.round("score", 5).alias("score"))


@Q.add("area_lookup", """
    SELECT c_custkey, round(v, 4) AS around FROM customer JOIN (SELECT s_nationkey, sum(s_acctbal) AS v FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def area_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Nations as hexagons of a row: a customer stands at its nation's centre."""
    from meridian.functions import geo

    x, y = geo.hex_center(F.col("n").cast("double"), F.lit(0.0), 10.0)
    areas = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("q")).agg(F.sum("s_acctbal").alias("v")).withColumn("r", F.lit(0).cast("long"))
    people = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_nationkey").alias("n")).withColumns({"x": x, "y": y})
    return products.area_detail(people, areas, 10.0).select("c_custkey", F.round("v", 4).alias("around"))


_BAND = "CASE WHEN score >= 75 THEN 'High' WHEN score >= 50 THEN 'Elevated' WHEN score >= 25 THEN 'Moderate' ELSE 'Lower' END"


@Q.add("segment_detail", f"""
    WITH f AS (SELECT p_partkey, CAST(p_size / 20.0 AS DOUBLE) AS size, ln(1 + p_retailprice) AS price FROM part),
    s AS (SELECT p_partkey, size - avg(size) OVER () AS size, price - avg(price) OVER () AS price, avg(size) OVER () + avg(price) OVER () AS base FROM f),
    k AS (SELECT DISTINCT l_partkey, CAST(l_quantity AS INTEGER) % 24 AS cell FROM lineitem), t AS (SELECT base + size + price AS v FROM s),
    r AS (SELECT l_partkey * 100 + cell AS id, base, size, price, CAST(cell / 10.0 - 1.0 AS DOUBLE) AS hour, CAST(0.1 * (cell % 2) AS DOUBLE) AS wet FROM k JOIN s ON p_partkey = l_partkey),
    {attribution_sql("r", "id", ["size", "price", "hour", "wet"], "t", 5)}
    SELECT l_orderkey AS key, l_partkey AS seg, CAST(l_quantity AS INTEGER) % 24 AS cell, score, {_BAND} AS band, baseline, factors, remainder
    FROM lineitem JOIN told ON id = l_partkey * 100 + CAST(l_quantity AS INTEGER) % 24""")
def segment_detail(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("seg"), (F.col("p_size").cast("double") / 20).alias("size"), F.log1p("p_retailprice").alias("price"))
    seg = scoring.centered_factors(parts, ["size", "price"])
    cells = spark.createDataFrame([(i, i / 10 - 1.0, 0.1 * (i % 2)) for i in range(24)], "cell int, hour double, wet double")
    q = scoring.quantile_table(seg.select((F.col("base") + F.col("size") + F.col("price")).alias("v")), "v")
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("seg"), (F.col("l_quantity") % 24).cast("int").alias("cell"))
    out = products.segment_detail(seg, cells, asked, ["size", "price"], ["hour", "wet"], q)
    return out.select("key", "seg", "cell", "score", "band", "baseline", F.to_json("factors").alias("factors"), "remainder")


@Q.add("route_answer", f"""
    WITH {_CHOSEN} SELECT query, CAST(weight AS DOUBLE) AS weight, status, CAST(CASE WHEN shown AND e0 <> 0 THEN greatest(0, round_even((1 - exposure / e0) * 100, 0)) ELSE 0 END AS INTEGER) AS reduction_pct,
           CAST(round_even(duration - t0, 0) AS INTEGER) AS extra_s, CASE WHEN shown THEN 'lower_risk_found' ELSE 'already_lowest' END AS message FROM c""")
def route_answer(spark: SparkSession, d: str) -> DataFrame:
    from meridian.plans.q_space import candidates

    out = products.route_answer(routing.decide(candidates(spark, d)))
    return out.select("query", "weight", "status", F.coalesce("reduction_pct", F.lit(0)).alias("reduction_pct"), "extra_s", "message")


@Q.add("mixture_log_rate", """
    WITH n AS (SELECT l_suppkey, l_returnflag AS g, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY l_suppkey) AS share FROM lineitem GROUP BY 1, 2),
    m AS (SELECT * FROM (VALUES ('A', 0, 0.5), ('N', 0, 1.0), ('R', 0, 2.0), ('A', 1, 1.5), ('N', 1, 0.2), ('R', 1, 0.0)) t(g, cell, x))
    SELECT l_suppkey, cell, round(ln(greatest(1e-12, sum(CAST(share AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS log_rate FROM n JOIN m USING (g) GROUP BY 1, 2""")
def mixture_log_rate(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("group")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("l_suppkey")))
    rows = [("A", 0, 0.5), ("N", 0, 1.0), ("R", 0, 2.0), ("A", 1, 1.5), ("N", 1, 0.2), ("R", 1, 0.0)]
    m = spark.createDataFrame(rows, "group string, cell int, multiplier double")
    return products.area_log_rate(shares, m, ["l_suppkey"]).withColumn("log_rate", F.round("log_rate", 6))


@Q.add("area_answers", f"""
    WITH n AS (SELECT s_nationkey AS q, count(*) AS n, sum(s_acctbal) / 10000 AS wealth FROM supplier GROUP BY 1),
    a AS (SELECT q, ln(1 + n) - avg(ln(1 + n)) OVER () AS crowd, wealth - avg(wealth) OVER () AS wealth, avg(ln(1 + n)) OVER () + avg(wealth) OVER () AS base FROM n),
    g AS (SELECT s_nationkey AS q, s_suppkey % 3 AS g, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY s_nationkey) AS share FROM supplier GROUP BY 1, 2),
    l AS (SELECT q, cell, ln(greatest(1e-12, sum(share * CASE cell WHEN 0 THEN 0.5 + g ELSE 2.0 - g / 2.0 END))) AS time_of_week FROM g, range(2) t(cell) GROUP BY 1, 2),
    t AS (SELECT base + crowd + wealth AS v FROM a), r AS (SELECT q * 10 + cell AS id, base, crowd, wealth, CAST(time_of_week AS DOUBLE) AS time_of_week FROM a JOIN l USING (q)),
    {attribution_sql("r", "id", ["crowd", "wealth", "time_of_week"], "t", 4)}
    SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS q, CAST(c_custkey % 2 AS INTEGER) AS cell, score, {_BAND} AS band, baseline, factors, remainder FROM customer JOIN told ON id = c_nationkey * 10 + c_custkey % 2""")
def area_answers(spark: SparkSession, d: str) -> DataFrame:
    """Nations as hexagons of a row: what makes up the score of each customer's, at one of two kinds of hour."""
    from meridian.functions import geo

    supplier = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("q"), F.lit(0).cast("long").alias("r"), (F.col("s_suppkey") % 3).alias("group"), "s_acctbal")
    raw = supplier.groupBy("q", "r").agg(F.log1p(F.count("*").cast("double")).alias("crowd"), (F.sum("s_acctbal") / 10_000).alias("wealth"))
    areas = scoring.centered_factors(raw, ["crowd", "wealth"])
    counts = supplier.groupBy("q", "r", "group").agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("q", "r")))
    multipliers = spark.createDataFrame([(g, c, 2.0 - g / 2 if c else 0.5 + g) for g in range(3) for c in range(2)], "group long, cell int, multiplier double")
    rates = products.area_log_rate(shares, multipliers, ["q", "r"])
    scale = scoring.quantile_table(areas.select((F.col("base") + F.col("crowd") + F.col("wealth")).alias("v")), "v")
    x, y = geo.hex_center(F.col("c_nationkey").cast("double"), F.lit(0.0), 10.0)
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), x.alias("x"), y.alias("y"), (F.col("c_custkey") % 2).cast("int").alias("cell"))
    out = products.area_answers(asked, areas, rates, ["crowd", "wealth"], scale, 10.0)
    return out.select("key", "q", "cell", "score", "band", "baseline", F.to_json("factors").alias("factors"), "remainder")


@Q.add("day_part_bands")
def day_part_bands(spark: SparkSession, d: str) -> DataFrame:
    """Users as areas: errors in each part of the day against the mean value of their events there."""
    rows = table(spark, d, "events").withColumn("day_part", times.day_part(F.hour("ts")))
    parts = rows.groupBy("user_id", "day_part").agg(F.sum((F.col("event_type") == "error").cast("long")).alias("count"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("rate"))
    return safety.incident_bands(parts, "count", "rate").select("user_id", "day_part", "count", F.round("exposure", 6).alias("exposure"), "band")


@Q.add("fix_suggestions", """
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 7 = 0 THEN 'lamps' ELSE 'narrower road' END, CASE WHEN p_size % 2 = 0 THEN 'crossing' END, CASE WHEN p_size % 5 >= 2 AND p_size % 7 > 0 THEN 'lamps' END], lambda x: x IS NOT NULL), '; ') AS fixes FROM part""")
def fix_suggestions(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame([("road", "narrower road"), ("history", "crossing"), ("dark", "lamps"), ("unlit", "lamps")], "factor string, suggestion string")
    first = F.when(F.col("p_size") % 7 == 0, "unlit").otherwise("road")
    names = F.array(first, F.when(F.col("p_size") % 2 == 0, "history").otherwise("unheard_of"), F.when(F.col("p_size") % 5 >= 2, "dark"))
    found = table(spark, d, "part").select("p_partkey", names.alias("factors"))
    return products.suggestions(found, catalog, "p_partkey").select("p_partkey", F.array_join("suggestions", "; ").alias("fixes"))


@Q.add("evidence_sentence", """
    SELECT s_suppkey, s_name || ' scores ' || CAST(s_suppkey % 101 AS VARCHAR) || ' of 100' || CASE WHEN s_nationkey > 10 THEN ', raised by road type' ELSE '' END || CASE WHEN s_nationkey < 20 THEN ', lowered by light' ELSE '' END || '.' AS sentence FROM supplier""")
def evidence_sentence(spark: SparkSession, d: str) -> DataFrame:
    factor = lambda n, p: F.struct(F.lit(n).alias("name"), p.cast("int").alias("points"))
    factors = F.array(factor("road_type", F.greatest(F.lit(0), F.col("s_nationkey") - 10)), factor("light", F.least(F.lit(0), F.col("s_nationkey") - 20)))
    told = products.evidence((F.col("s_suppkey") % 101).cast("int"), factors)
    return table(spark, d, "supplier").select("s_suppkey", products.sentence(F.col("s_name"), told).alias("sentence"))


@Q.add("largest_group_share", """
    SELECT c_mktsegment, round(max(n) / sum(n), 6) AS share FROM (SELECT c_mktsegment, c_nationkey, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def largest_group_share(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return n.groupBy("c_mktsegment").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@Q.add("bounded_gazetteer", """
    WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, label AS w FROM embeddings),
    r AS (SELECT a.id, b.id AS near_id FROM p a LEFT JOIN p b ON b.w = 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 20 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) = 1)
    SELECT id, coalesce('place ' || CAST(near_id AS VARCHAR), 'Start point') AS label FROM r""")
def bounded_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    near = spatial.nearest(p, p.where("w = 0"), 20.0, limit=20.0)
    name = F.coalesce(F.concat(F.lit("place "), F.col("near_id").cast("string")), F.lit("Start point"))
    return p.select("id").join(near, "id", "left").select("id", name.alias("label"))


@Q.add("text_validator_codes", f"""
    SELECT conv_id, turn, len(text) > 420 AS too_long, len(list_filter(string_split_regex(text, '[.!?]+(?:\\s|$)'), lambda x: trim(x) <> '')) > 3 AS too_many_sentences,
           array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{text.banned_pattern(text.BANNED_TERMS)}', 1), lambda x: lower(x)))), ',') AS banned,
           regexp_matches(text, '(?i)https?://|www\\.') AS link,
           len(list_filter(list_distinct(list_transform(regexp_extract_all(text, '\\d+', 0), lambda x: CAST(x AS DOUBLE))), lambda x: x <> turn)) AS unknown_numbers FROM conversations""")
def text_validator_codes(spark: SparkSession, d: str) -> DataFrame:
    """All five codes; the only number that a text may hold is that of its turn, and digits count as numbers wherever they stand."""
    codes, digits = text.text_errors(F.col("text")), F.regexp_replace("text", "[^0-9]+", " ")
    banned = F.transform(F.filter(codes, lambda c: c.startswith("banned:")), lambda c: F.substring(c, 8, 100))
    unknown = F.filter(text.text_errors(digits, F.array(F.col("turn").cast("double"))), lambda c: c.startswith("unknown_number:"))
    has = lambda c: F.array_contains(text.error_kinds(codes), c).alias(c)
    return table(spark, d, "conversations").select("conv_id", "turn", has("too_long"), has("too_many_sentences"), F.array_join(banned, ",").alias("banned"), has("link"), F.size(unknown).cast("long").alias("unknown_numbers"))


@Q.add("route_reports", """
    SELECT DISTINCT l_orderkey AS query, p_partkey AS seg, p_name AS name, p_size * 2.0 AS x, p_size * 3.0 AS y FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40""")
def route_reports(spark: SparkSession, d: str) -> DataFrame:
    """Parts as segments, orders as paths over them, a report on each large part."""
    parts = table(spark, d, "part")
    reports = parts.where("p_size > 40").select(F.col("p_partkey").alias("seg"), F.col("p_name").alias("name"), F.lit(-1.0).alias("x"))
    segments = parts.select(F.col("p_partkey").alias("seg"), (F.col("p_size") * 2.0).alias("x"), (F.col("p_size") * 3.0).alias("y"))
    paths = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("seg"))
    return products.route_reports(reports, paths, segments)


@Q.add("safety_line", """
    SELECT s_suppkey, coalesce(nullif(concat_ws(' · ', CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || CASE WHEN n = 1 THEN ' report' ELSE ' reports' END END, CASE WHEN s_acctbal > 0 THEN 'lit' END), ''), '-') AS line
    FROM (SELECT *, s_nationkey % 3 AS n FROM supplier)""")
def safety_line(spark: SparkSession, d: str) -> DataFrame:
    line = products.told([products.counted(F.col("s_nationkey") % 3, "report"), F.when(F.col("s_acctbal") > 0, "lit")], " · ")
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(line, F.lit("-")).alias("line"))


@Q.add("lamp_union", """
    SELECT x, count(*) AS n FROM (SELECT s_nationkey * 1.0 AS x, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS y FROM supplier UNION ALL SELECT c_nationkey * 1.0, c_acctbal FROM customer) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def lamp_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select((F.col("s_nationkey") * 1.0).alias("x"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("y"))
    b = table(spark, d, "customer").select((F.col("c_nationkey") * 1.0).alias("x"), F.col("c_acctbal").alias("y"))
    return safety.lamp_points([a, b]).groupBy("x").agg(F.count("*").alias("n"))


@Q.add("graph_index", """
    WITH n AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part WHERE p_size % 3 > 0)
    SELECT l_orderkey, l_linenumber, l_partkey AS u, l_suppkey AS v, a.index AS u_index, b.index AS v_index FROM lineitem JOIN n a ON a.id = l_partkey JOIN n b ON b.id = l_suppkey""")
def graph_index(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").where("p_size % 3 > 0").select(F.col("p_partkey").alias("id"))
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))
    return routing.build_graph(nodes, edges)[1]


@Q.add("thin_order", """
    WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings WHERE label = 3),
    w AS (SELECT n, [{'id': id, 'x': x, 'y': y}] AS kept FROM p WHERE n = 1
          UNION ALL SELECT p.n, CASE WHEN len(list_filter(w.kept, lambda k: sqrt((k.x - p.x) ** 2 + (k.y - p.y) ** 2) <= 30)) = 0 THEN list_append(w.kept, {'id': p.id, 'x': p.x, 'y': p.y}) ELSE w.kept END FROM w JOIN p ON p.n = w.n + 1)
    SELECT unnest(kept).id AS id FROM w WHERE n = (SELECT max(n) FROM w)""")
def thin_order(spark: SparkSession, d: str) -> DataFrame:
    """Points of one label thinned in the order of their ids."""
    return safety.thin_points(points(spark, d).where("w = 3"), 30.0, ["w"]).select("id")


@Q.add("ranked_suggestions", """
    WITH RECURSIVE p AS (SELECT user_id, event_id, value, event_id * 37 % 1000 AS x, event_id * 91 % 1000 AS y FROM events WHERE sqrt((event_id * 37 % 1000 - 500) ** 2 + (event_id * 91 % 1000 - 500) ** 2) > 200),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM p),
    w AS (SELECT user_id, n, [{'id': event_id, 'x': x, 'y': y}] AS kept FROM o WHERE n = 1
          UNION ALL SELECT o.user_id, o.n, CASE WHEN len(list_filter(w.kept, lambda k: sqrt((k.x - o.x) ** 2 + (k.y - o.y) ** 2) <= 150)) = 0 THEN list_append(w.kept, {'id': o.event_id, 'x': o.x, 'y': o.y}) ELSE w.kept END
          FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
    SELECT user_id, unnest(kept[1:5]).id AS event_id, unnest(range(1, least(len(kept), 5) + 1)) AS rank FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def ranked_suggestions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_id") * 37 % 1000).cast("double").alias("x"), (F.col("event_id") * 91 % 1000).cast("double").alias("y"))
    out = trips.ranked_suggestions(c, 5, F.lit(500.0), F.lit(500.0))
    return out.select(F.col("user").alias("user_id"), F.col("id").alias("event_id"), F.col("rank").cast("long").alias("rank"))
