"""Revisit resolution for web captures.

A not-modified revisit holds no body. It is resolved to the latest earlier full response
with the same canonical URL, as an as-of join. The response's validators must agree with
the revisit's; then the revisit's headers are merged into the stored ones, but for those
that describe the stored body.

The as-of join is cut by ranges of (URL, time): a summary of each (URL, range) gives what
a range starts from, and each range then looks back on its own. However many captures one
URL has, and however their times lie, a task holds one range of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meridian.plans.scratch import Scratch

#: Headers of a stored response that a not-modified answer does not change (lower case).
KEPT_HEADERS = ["content-encoding", "content-length", "content-location", "content-range", "content-type", "transfer-encoding"]
#: Query parameters and host prefixes without influence on what is served.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
HOST_PREFIX = "www[0-9]*|m"


def canonical_url(url: Column, prefix: str = HOST_PREFIX) -> Column:
    """Host in lower case without `prefix` and default port; path without a last slash; query sorted and without tracking; no scheme, user or fragment.

    An empty `prefix` tells hosts apart as they are. A null url gives null, an empty one an empty text.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(place, "^([^/]*)", 1), "^[^@]*@", ""))
    host = F.regexp_replace(host, ":(80|443)$", "")
    host = F.regexp_replace(host, f"^({prefix})[.]", "") if prefix else host
    path = F.regexp_replace(F.regexp_extract(place, "^[^/]*(/.*)?$", 1), "/+$", "")
    args = F.array_sort(F.filter(F.split(query, "&"), lambda a: (a != "") & ~a.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """The map with names in lower case; of names that differ by case only the last in byte order stays, as a map has no order of its own."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string,string>)"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names) + 1), F.lower(e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored map updated by the fresh one, but for KEPT_HEADERS; names are lower-cased.

    Null maps count as empty ones. Of names of a map that differ by case only the last in byte order counts.
    """
    new = F.map_filter(_lowered(fresh), lambda k, v: ~k.isin(KEPT_HEADERS))
    return F.map_concat(F.map_filter(_lowered(stored), lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def resolve_revisits(records: DataFrame, ranges: int | None = None, prefix: str = HOST_PREFIX) -> DataFrame:
    """One row per revisit of `records`: its columns, canonical_url, status, refers_to and headers_merged.

    `records` has record_id, url, time (long), kind ('response' or 'revisit'), etag,
    last_modified and headers (map). Earlier means a smaller (time, record_id). status is
    `resolved` if the latest earlier response of the canonical URL has the validators the
    revisit gives (etag if it has one, else last_modified; one without either can't be
    checked and is `unchecked`), `mismatch` if not, and `missing` without any earlier
    response. refers_to is the response's record_id unless missing; headers_merged is null
    unless resolved. `prefix` names host prefixes that canonical URLs drop; with an empty one
    http://m.h and http://h are not the same. `ranges` is how many ranges of (URL, time) the
    work is cut into (as many as shuffles have partitions if not given); it decides no result.

    A null url has no earlier response. Null times count as the earliest. Null headers count
    as empty. Repeated rows give repeated results. Columns of `records` named like an added
    one are replaced, others pass through whatever their names. An empty table gives an empty
    result.
    """
    spark = records.sparkSession
    scratch = Scratch(spark)
    added = ("canonical_url", "status", "refers_to", "headers_merged")
    kept = [c for c in records.columns if c not in added]
    at = F.coalesce("time", F.lit(-(1 << 62)))
    base = records.where("kind in ('response', 'revisit')")
    own = F.struct(*[F.col(c) for c in kept]).alias("__row")
    keys = [F.col(c).alias(f"__{c}") for c in ("record_id", "kind", "etag", "last_modified", "headers")]
    base = base.select(canonical_url(F.col("url"), prefix).alias("__url"), at.alias("__at"), *keys, F.when(F.col("kind") == "revisit", own).alias("__row"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.repartitionByRange(n, "__url", "__at", "__record_id").withColumn("__range", F.spark_partition_id())
    dealt = scratch.write(dealt)
    found = F.struct(*[f"__{c}" for c in ("at", "record_id", "etag", "last_modified", "headers")])
    response = F.col("__kind") == "response"
    ends = dealt.where(response & F.col("__url").isNotNull()).groupBy("__url", "__range")
    ends = ends.agg(F.max_by(found, F.struct("__at", "__record_id")).alias("__last"))
    # a range without a response of its own still needs a row to look back from
    asks = dealt.where(~response).select("__url", "__range").distinct().withColumn("__last", F.lit(None))
    steps = ends.unionByName(asks).groupBy("__url", "__range").agg(F.first("__last", ignorenulls=True).alias("__last"))
    key = Window.partitionBy("__url").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("__carried", F.last("__last", ignorenulls=True).over(key)).where("__carried is not null")
    carried = scratch.write(carried.select("__url", "__range", "__carried"))
    order = Window.partitionBy("__url", "__range").orderBy("__at", "__record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(response, found), ignorenulls=True).over(order)
    seen = dealt.withColumn("__near", F.when(F.col("__url").isNotNull(), near)).where(~response)
    seen = seen.join(carried, ["__url", "__range"], "left").withColumn("__from", F.coalesce("__near", "__carried"))
    source = F.col("__from")
    agrees = F.when(F.col("__etag").isNotNull(), F.col("__etag").eqNullSafe(source["__etag"])).when(
        F.col("__last_modified").isNotNull(), F.col("__last_modified").eqNullSafe(source["__last_modified"])
    )
    status = F.when(source.isNull(), "missing").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    return seen.select(
        *[F.col("__row")[c].alias(c) for c in kept], F.col("__url").alias("canonical_url"), status.alias("status"), source["__record_id"].alias("refers_to"),
        F.when(status == "resolved", merge_headers(source["__headers"], F.col("__headers"))).alias("headers_merged"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Captures made from a table of pages (page_id, url, html): responses, and later revisits of them.

    The response of a page has time 10 * page_id, its revisit comes 4000 later, so that other
    captures of the same URL can lie between. What a page has follows from the hexadecimal
    digits of digests: no response if that of the URL starts with 1. If that of the text
    starts with 0 its revisit gives last_modified alone; if with 2, no validator; if with 3, an
    etag of another text; else the response's own etag. A null text counts as an empty one,
    a null url stays null and has a response. Repeated rows give repeated records, other
    columns are ignored and an empty table gives an empty result.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    modified = F.concat(F.lit("day "), F.substring(digest, 1, 2))
    common = pages.select("page_id", "url", digest.alias("etag"), modified.alias("last_modified"), size.alias("size"))
    response = common.where(~F.coalesce(F.md5("url"), F.lit("")).startswith("1")).select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("time"), F.lit("response").alias("kind"), "etag", "last_modified",
        F.create_map(F.lit("Content-Length"), F.col("size"), F.lit("Date"), F.col("page_id").cast("string"), F.lit("Server"), F.lit("a")).alias("headers"),
    )
    first = F.substring("etag", 1, 1)
    again = common.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + 4000).alias("time"), F.lit("revisit").alias("kind"),
        F.when(first == "3", F.reverse("etag")).when(~first.isin("0", "2"), F.col("etag")).alias("etag"),
        F.when(first != "2", F.col("last_modified")).alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") + 400).cast("string"), F.lit("x-cache"), F.lit("hit")).alias("headers"),
    )
    return response.unionByName(again)


SQL = r"""
WITH bare AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
part AS (SELECT page_id, html, regexp_extract(u, '^([^?]*)', 1) AS place, regexp_extract(u, '\?(.*)$', 1) AS query FROM bare),
piece AS (SELECT page_id, html,
            regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(place, '^([^/]*)', 1), '^[^@]*@', '')), ':(80|443)$', ''), '^(www[0-9]*|m)[.]', '') AS host,
            regexp_replace(regexp_extract(place, '^[^/]*(/.*)?$', 1), '/+$', '') AS path,
            list_sort(list_filter(string_split(query, '&'), lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS args FROM part),
page AS (SELECT page_id, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical_url, url,
            md5(html) AS etag, 'day ' || substr(md5(html), 1, 2) AS modified, CAST(length(html) AS VARCHAR) AS size FROM piece JOIN (SELECT page_id, url FROM pages) USING (page_id)),
res AS (SELECT page_id * 2 AS record_id, canonical_url, page_id * 10 AS t, etag, modified, size, page_id FROM page WHERE coalesce(md5(url), '') NOT LIKE '1%'),
rev AS (SELECT page_id * 2 + 1 AS record_id, canonical_url, page_id * 10 + 4000 AS t, page_id,
               CASE WHEN etag LIKE '3%' THEN reverse(etag) WHEN etag NOT LIKE '0%' AND etag NOT LIKE '2%' THEN etag END AS etag, CASE WHEN etag NOT LIKE '2%' THEN modified END AS modified FROM page),
found AS (SELECT rev.record_id, rev.canonical_url, rev.etag, rev.modified, rev.page_id, res.record_id AS refers_to, res.etag AS e, res.modified AS m, res.size
          FROM rev LEFT JOIN res ON res.canonical_url = rev.canonical_url AND (res.t < rev.t OR res.t = rev.t AND res.record_id < rev.record_id)
          QUALIFY row_number() OVER (PARTITION BY rev.record_id ORDER BY res.t DESC NULLS LAST, res.record_id DESC NULLS LAST) = 1),
said AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'missing' WHEN etag IS NOT NULL THEN CASE WHEN etag = e THEN 'resolved' ELSE 'mismatch' END
                        WHEN modified IS NULL THEN 'unchecked' WHEN modified = m THEN 'resolved' ELSE 'mismatch' END AS status FROM found)
SELECT record_id, canonical_url, status, coalesce(refers_to, -1) AS refers_to,
       CASE WHEN status = 'resolved' THEN 'content-length=' || size || ';date=' || CAST(page_id + 400 AS VARCHAR) || ';server=a;x-cache=hit' END AS headers
FROM said
"""
