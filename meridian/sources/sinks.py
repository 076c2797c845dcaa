"""Sinks: versioned tables with a manifest, packed scores, GeoJSON."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table_digest(df: DataFrame) -> DataFrame:
    """(n, digest) of a table's rows whatever their order: the sum and xor of row hashes, in hex."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    total = F.sum(h.cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("n"), F.substring(F.sha2(F.concat_ws("|", F.count("*"), total, F.bit_xor(h)), 256), 1, 32).alias("digest"))


def write_version(tables: dict[str, DataFrame], root: str, version: str, derived_from: str | None = None) -> DataFrame:
    """Write tables under root/version and a manifest of their digests; an existing version is an error.

    Returns the manifest: version, name, n, digest, derived_from.
    """
    manifest = None
    for name, df in tables.items():
        path = f"{root}/{version}/{name}"
        df.write.mode("errorifexists").parquet(path)
        row = table_digest(df.sparkSession.read.parquet(path)).select(F.lit(version).alias("version"), F.lit(name).alias("name"), "n", "digest", F.lit(derived_from).cast("string").alias("derived_from"))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("errorifexists").parquet(f"{root}/{version}/_manifest_table")
    return manifest.sparkSession.read.parquet(f"{root}/{version}/_manifest_table")


def read_version(spark: SparkSession, root: str, version: str, required: list[str], optional: list[str] = ()) -> dict[str, DataFrame | None]:
    """Tables of a version, checked against its manifest. A required one that is missing or changed is an error; an optional one is None."""
    known = {r["name"]: r["digest"] for r in spark.read.parquet(f"{root}/{version}/_manifest_table").collect()}
    out: dict[str, DataFrame | None] = {}
    for name in [*required, *optional]:
        if name not in known:
            if name in required:
                raise ValueError(f"{version} has no {name}")
            out[name] = None
            continue
        df = spark.read.parquet(f"{root}/{version}/{name}")
        if table_digest(df).first()["digest"] != known[name]:
            raise ValueError(f"{name} of {version} is not what its manifest says")
        out[name] = df
    return out


def changed_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, state) of manifest entries that differ: added, removed or changed."""
    both = a.select("name", F.col("digest").alias("da")).join(b.select("name", F.col("digest").alias("db")), "name", "full")
    state = F.when(F.col("da").isNull(), "added").when(F.col("db").isNull(), "removed").when(F.col("da") != F.col("db"), "changed")
    return both.select("name", state.alias("state")).where("state is not null")


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("version string, n long, at long").parquet(f"{root}/_current")


def point_to(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the current one. Pointers are numbered and only ever added, so readers see the old or the new one at any time, whatever the writers' clocks say."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_current")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    n = (_pointers(spark, root).agg(F.max("n")).first()[0] or 0) + 1 if there else 1
    spark.createDataFrame([(version, n, time.time_ns())], "version string, n long, at long").coalesce(1).write.mode("append").parquet(f"{root}/_current")


def current(spark: SparkSession, root: str) -> str:
    """The version that was pointed to last: of the greatest number, and of two writers that took the same one the later by its clock."""
    return _pointers(spark, root).agg(F.max_by("version", F.struct("n", "at")).alias("version")).first()["version"]


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key the parent lacks; a null key is none."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def geojson(path: Column, properties: Column, decimals: int = 5) -> Column:
    """A line feature as JSON text."""
    points = F.transform(path, lambda p: F.array(F.round(p["x"], decimals), F.round(p["y"], decimals)))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), points.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def outline(rings: Column, properties: Column, tolerance: float, decimals: int = 5) -> Column:
    """A polygon feature as JSON text, its rings simplified."""
    from meridian.functions import geo

    points = F.transform(geo.simplify_rings(rings, tolerance), lambda r: F.transform(r, lambda p: F.array(F.round(p["x"], decimals), F.round(p["y"], decimals))))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), points.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def write_partitioned(df: DataFrame, path: str, ts: str, days: int = 90, order: list[str] = ()) -> None:
    """Parquet by chunks of `days`, sorted within files; a chunk is spread over as many tasks as its rows need."""
    chunk = F.floor(F.datediff(F.col(ts), F.lit("1970-01-01")) / days).cast("int")
    out = df.withColumn("chunk", chunk).hint("rebalance", "chunk")
    (out.sortWithinPartitions("chunk", *order) if order else out).write.mode("overwrite").partitionBy("chunk").parquet(path)


def replace_partition(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """One compact JSON object per line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def merge_checked(current: DataFrame, updates: DataFrame, key: str, stamp: str) -> DataFrame:
    """`current` with rows replaced by updates whose `expected` stamp is still the row's; others stay as they are.

    `updates` has the columns of `current` and expected; one update per key.
    """
    u = updates.select(F.col(key), "expected", F.struct(*current.columns).alias("new"))
    joined = current.join(u, key, "left")
    fits = F.col("new").isNotNull() & F.col("expected").eqNullSafe(F.col(stamp))
    return joined.select(*[F.when(fits, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in current.columns])
