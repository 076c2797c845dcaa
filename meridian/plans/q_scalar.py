"""Named queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meridian.functions import text, times
from meridian.plans.registry import Registry, table

Q = Registry()

_ID = "CASE event_id % 5 WHEN 0 THEN '(K) Fatal' WHEN 1 THEN '(A) Serious' WHEN 2 THEN 'unknown' WHEN 3 THEN '(Z) odd' END"


@Q.add("severity_extract", f"""
    SELECT event_id, nullif(regexp_extract({_ID}, '^\\(([KABCO])\\)', 1), '') AS severity FROM events""")
def severity_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.severity_letter(F.expr(_ID)).alias("severity"))


@Q.add("digits_only_id", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN regexp_full_match(v, '[0-9]+') THEN v END AS clean_id
    FROM (SELECT *, trim(CASE WHEN l_partkey % 3 = 0 THEN 'x' || CAST(l_partkey AS VARCHAR) ELSE ' ' || CAST(l_partkey AS VARCHAR) || ' ' END) AS v FROM lineitem)""")
def digits_only_id(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE WHEN l_partkey % 3 = 0 THEN 'x' || CAST(l_partkey AS STRING) ELSE ' ' || CAST(l_partkey AS STRING) || ' ' END")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.digits_only(raw).alias("clean_id"))


@Q.add("first_number", """
    SELECT event_id, CAST(nullif(regexp_extract(props, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS k FROM events""")
def first_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.first_number(F.col("props")).alias("k"))


@Q.add("truthy_flags", """
    SELECT event_id, coalesce(lower(CASE event_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'Yes' END) IN ('true', '1', 'yes'), FALSE) AS flag FROM events""")
def truthy_flags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'Yes' END")
    return table(spark, d, "events").select("event_id", text.truthy(raw).alias("flag"))


@Q.add("tag_lists", """
    SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || '; ' || upper(p_brand) || ' ;', ';'), lambda x: lower(trim(x))), lambda x: x <> ''), ',') AS tags
    FROM part""")
def tag_lists(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_type", F.lit("; "), F.upper("p_brand"), F.lit(" ;"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.tag_values(raw), ",").alias("tags"))


_HIGHWAY = "CASE p_partkey % 7 WHEN 0 THEN 'primary_link;service' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'steps;path' WHEN 5 THEN 'motorway' END"
_LIST = f"list_transform(list_filter(list_transform(string_split(coalesce({_HIGHWAY}, ''), ';'), lambda x: lower(trim(x))), lambda x: x <> ''), lambda x: regexp_replace(x, '_link$', ''))"


@Q.add("highway_classes", f"""
    SELECT p_partkey,
           CASE WHEN p_size % 9 = 0 THEN 'crossing'
                WHEN list_has_any({_LIST}, ['motorway','trunk','primary','secondary','tertiary','unclassified','residential','living_street','service','road']) THEN 'road' ELSE 'path' END AS kind,
           CASE WHEN list_has_any({_LIST}, ['motorway','trunk','primary','secondary']) THEN 'arterial'
                WHEN list_has_any({_LIST}, ['tertiary','unclassified']) THEN 'collector' ELSE 'local' END AS road_group
    FROM part""")
def highway_classes(spark: SparkSession, d: str) -> DataFrame:
    highway, footway = F.expr(_HIGHWAY), F.when(F.col("p_size") % 9 == 0, "crossing")
    return table(spark, d, "part").select("p_partkey", text.edge_kind(highway, footway).alias("kind"), text.road_group(highway).alias("road_group"))


@Q.add("lit_tags", """
    SELECT p_partkey, CASE WHEN v IN ('yes','24/7','automatic','sunset-sunrise','dusk-dawn') THEN 1 WHEN v IN ('no','disused') THEN 0 ELSE -1 END AS lit
    FROM (SELECT p_partkey, lower(trim(CASE p_size % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'dusk-dawn' WHEN 3 THEN 'maybe' END)) AS v FROM part)""")
def lit_tags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE p_size % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'dusk-dawn' WHEN 3 THEN 'maybe' END")
    return table(spark, d, "part").select("p_partkey", text.lit_tag(raw).alias("lit"))


_WAY = "CASE p_size % 6 WHEN 0 THEN 'track' WHEN 1 THEN 'lane;shared_lane' WHEN 2 THEN 'share_busway' WHEN 3 THEN 'none' END"


@Q.add("cycle_facility", f"""
    SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 3 WHEN w = 'track' THEN 3 WHEN w = 'lane;shared_lane' THEN 2 WHEN w = 'share_busway' THEN 1 ELSE 0 END AS facility
    FROM (SELECT p_partkey, {_WAY} AS w FROM part)""")
def cycle_facility(spark: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(F.lit("cycleway:left"), F.expr(_WAY), F.lit("highway"), F.when(F.col("p_partkey") % 11 == 0, "cycleway"))
    return table(spark, d, "part").select("p_partkey", text.facility_class(tags).alias("facility"))


@Q.add("band_counts", """
    SELECT CASE WHEN s >= 75 THEN 'High' WHEN s >= 50 THEN 'Elevated' WHEN s >= 25 THEN 'Moderate' ELSE 'Lower' END AS band, count(*) AS n
    FROM (SELECT event_id % 101 AS s FROM events) GROUP BY 1""")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(text.band(F.col("event_id") % 101).alias("band")).agg(F.count("*").alias("n"))


@Q.add("route_key_hash", """
    SELECT o_orderkey, substr(sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority), 1, 16) AS route_key FROM orders""")
def route_key_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.canonical_key(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("route_key"))


@Q.add("text_flatten", """
    SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 80) AS label FROM documents""")
def text_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("label"))


@Q.add("sentence_count", """
    SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?]+(?:\\s|$)'), lambda x: trim(x) <> '')) AS INTEGER) AS sentences FROM documents""")
def sentence_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.sentence_count(F.col("text")).alias("sentences"))


@Q.add("banned_terms", """
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(
             regexp_extract_all(text, '(?i)\\b(error|idiot|of|the)(?:e?s)?\\b', 1), lambda x: lower(x)))), ',') AS terms FROM conversations""")
def banned_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = text.banned_terms(F.col("text"), ["error", "idiot", "of", "the"])
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(terms, ",").alias("terms"))


@Q.add("link_detect", """
    SELECT page_id, coalesce(regexp_matches(html, '(?i)https?://|www\\.'), FALSE) AS has_link FROM pages""")
def link_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.has_link(F.col("html")).alias("has_link"))


@Q.add("number_extract", """
    SELECT page_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(url, '[^0-9]+', ' ', 'g'), '\\d+', 0), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS numbers FROM pages""")
def number_extract(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace("url", "[^0-9]+", " ")
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(text.numbers_in(plain), lambda x: x.cast("long").cast("string")), ",").alias("numbers"))


@Q.add("unknown_numbers", """
    SELECT page_id, len(list_filter(list_distinct(regexp_extract_all(regexp_replace(url, '[^0-9]+', ' ', 'g'), '\\d+', 0)), lambda x: CAST(x AS BIGINT) <> page_id)) AS unknown FROM pages""")
def unknown_numbers(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace("url", "[^0-9]+", " ")
    errors = text.text_errors(plain, F.array(F.col("page_id").cast("double")), max_chars=10_000, max_sentences=10_000)
    return table(spark, d, "pages").select("page_id", F.size(F.filter(errors, lambda e: e.startswith("unknown_number"))).cast("long").alias("unknown"))


@Q.add("search_rank", """
    SELECT p_partkey, CAST(4 + CASE WHEN starts_with(lower(p_name), 'a e') THEN 2 ELSE 0 END AS INTEGER) AS score
    FROM part WHERE contains(lower(p_name || ' ' || p_type), 'a') AND contains(lower(p_name || ' ' || p_type), 'e')
    ORDER BY score DESC, p_partkey LIMIT 5""")
def search_rank(spark: SparkSession, d: str) -> DataFrame:
    score = text.search_score(F.col("p_name"), F.col("p_type"), "a e")
    return table(spark, d, "part").select("p_partkey", score.cast("int").alias("score")).where("score is not null").orderBy(F.desc("score"), "p_partkey").limit(5)


@Q.add("template_text", """
    SELECT user_id, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' event' ELSE ' events' END || CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 THEN '; ' || CAST(CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS VARCHAR) || ' failed' ELSE '' END AS sentence
    FROM events GROUP BY user_id""")
def template_text(spark: SparkSession, d: str) -> DataFrame:
    n, bad = F.count("*"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
    one = F.concat(n.cast("string"), F.when(n == 1, " event").otherwise(" events"))
    failed = F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" failed")))
    return table(spark, d, "events").groupBy("user_id").agg(F.concat_ws("; ", one, failed).alias("sentence"))


@Q.add("day_group_counts", """
    SELECT CASE WHEN isodow(ts) <= 4 THEN 'weekday' WHEN isodow(ts) = 5 THEN 'friday' WHEN isodow(ts) = 6 THEN 'saturday' ELSE 'sunday' END AS day_group,
           CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS day_part, count(*) AS n
    FROM events GROUP BY 1, 2""")
def day_group_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(times.day_group(F.col("ts")).alias("day_group"), times.day_part(F.hour("ts")).alias("day_part")).agg(F.count("*").alias("n"))


@Q.add("circular_mean_hour", """
    SELECT user_id, round(((atan2(sum(sin(h * pi() / 12)), sum(cos(h * pi() / 12))) * 12 / pi()) + 24) % 24, 4) AS mean_hour
    FROM (SELECT user_id, hour(ts) + minute(ts) / 60 AS h FROM events) GROUP BY user_id""")
def circular_mean_hour(spark: SparkSession, d: str) -> DataFrame:
    hour = F.hour("ts") + F.minute("ts") / 60
    return table(spark, d, "events").groupBy("user_id").agg(F.round(times.circular_mean_hour(hour), 4).alias("mean_hour"))


@Q.add("epoch_wall_clock", """
    SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS instant FROM events""")
def epoch_wall_clock(spark: SparkSession, d: str) -> DataFrame:
    """January has standard time all through, so the zone is five hours behind."""
    ms = (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).cast("long")
    at = times.from_epoch_ms(ms, wall_clock=True)
    return table(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("instant"))


@Q.add("decayed_pair_score", """
    SELECT user_id, event_type, round(sum(pow(0.5, (date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') / 86400.0) / 14)), 4) AS score
    FROM events GROUP BY user_id, event_type HAVING count(*) >= 2""")
def decayed_pair_score(spark: SparkSession, d: str) -> DataFrame:
    age = (F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400.0
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum(times.decay(age)), 4).alias("score"), F.count("*").alias("n")).where("n >= 2").drop("n")


@Q.add("wrap_hours", """
    SELECT r_regionkey, array_to_string(list_transform(range((6 - (20 + r_regionkey) + 24) % 24), lambda i: CAST((20 + r_regionkey + i) % 24 AS VARCHAR)), ',') AS hours FROM region""")
def wrap_hours(spark: SparkSession, d: str) -> DataFrame:
    hours = times.hours_between(F.lit(20) + F.col("r_regionkey"), F.lit(6))
    return table(spark, d, "region").select("r_regionkey", F.array_join(F.transform(hours, lambda h: h.cast("string")), ",").alias("hours"))
