"""Sources: raw layers of features as DataFrames."""

from __future__ import annotations

import json
import math
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
)

from meridian.functions import geo, times


@dataclass(frozen=True)
class Layer:
    """One declared layer: where it lies and which rows and columns of it are wanted."""

    key: str
    path: str
    columns: list[str] = field(default_factory=list)
    where: str | None = None
    order: list[str] = field(default_factory=list)


def read_layer(spark: SparkSession, layer: Layer) -> DataFrame:
    """A layer's rows and columns; both choices reach the parquet scan."""
    df = spark.read.parquet(layer.path)
    if layer.where:
        df = df.where(layer.where)
    return df.select(*layer.columns) if layer.columns else df


def register_layers(spark: SparkSession, layers: list[Layer]) -> tuple[list[str], dict[str, str]]:
    """Make each layer a temporary view; (keys that worked, errors of the others). One bad layer stops no other."""
    done, failed = [], {}
    for layer in layers:
        try:
            read_layer(spark, layer).createOrReplaceTempView(layer.key)
            done.append(layer.key)
        except Exception as e:  # noqa: BLE001  any fault of one source is reported, not raised
            failed[layer.key] = str(e).split("\n")[0]
    return done, failed


def nan_to_null(df: DataFrame) -> DataFrame:
    """`df` with null for NaN in its floating-point columns, since Spark's aggregates skip null only."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


#: Geometry of a feature: a point, the paths of a line or the rings of an area.
FEATURE = "attributes map<string,string>, geometry struct<x:double,y:double,paths:array<array<array<double>>>,rings:array<array<array<double>>>>"


def flatten_features(raw: DataFrame, column: str = "value") -> DataFrame:
    """Feature JSON, one per row, as attributes, lon, lat, paths and rings; what can't be read is all null."""
    f = F.from_json(column, FEATURE)
    return raw.select(f["attributes"].alias("attributes"), f["geometry"]["x"].alias("lon"), f["geometry"]["y"].alias("lat"), f["geometry"]["paths"].alias("paths"), f["geometry"]["rings"].alias("rings"))


def line_parts(df: DataFrame, paths: str = "paths") -> DataFrame:
    """One row per part of at least two vertices, as path (array of struct x, y); rows without geometry drop out."""
    part = F.explode(F.filter(F.coalesce(paths, F.expr("cast(array() as array<array<array<double>>>)")), lambda p: F.size(p) >= 2))
    out = df.select("*", part.alias("__part"))
    return out.withColumn("path", F.transform("__part", lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))).drop("__part", paths)


def coded_labels(c: Column) -> Column:
    """The number before the colon of '3: label'."""
    return F.split(c, ":")[0].try_cast("int")


def read_sharded(spark: SparkSession, pattern: str, codes: list[str] = ()) -> DataFrame:
    """All files of a pattern as one table, coded labels as numbers."""
    df = spark.read.option("mergeSchema", True).parquet(pattern)
    return df.withColumns({c: coded_labels(F.col(c)) for c in codes})


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, built and written first if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.parquet(path)
    return spark.read.parquet(path)


def hourly_weather(local: DataFrame, zone: str = times.ZONE) -> DataFrame:
    """(time, precip) by instants, from `local` (time as a zone's clock, precip).

    An hour that the clocks went through twice is dropped, one that never was moves to the
    first instant after it; so do rows without a time. Of rows that come to one instant the
    largest precipitation counts.
    """
    at = times.local_to_instant(F.col("time"), zone)
    return local.select(at.alias("time"), "precip").where("time is not null").groupBy("time").agg(F.max("precip").alias("precip"))


#: Elements of a map extract, one JSON object a line.
ELEMENTS = "type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>"


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a map extract in files of JSON lines; lines that are no element are dropped."""
    return spark.read.schema(ELEMENTS).json(path).where("type is not null and id is not null")


def map_features(elements: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(id, lat, lon, tags) of the nodes with any of the wanted values of a tag; an empty list takes every value."""
    hit = F.lit(False)
    for k, values in wanted.items():
        hit = hit | (F.col("tags")[k].isin(values) if values else F.col("tags")[k].isNotNull())
    return elements.where((F.col("type") == "node") & F.coalesce(hit, F.lit(False)) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", "lat", "lon", "tags")


def map_network(elements: DataFrame, tag: str = "highway") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon) and edges (way, pos, u, v, length, tags) of the ways that have `tag`: an edge per pair of nodes that follow each other.

    Edges with an unknown end are dropped; nodes are those that an edge has.
    """
    ways = elements.where((F.col("type") == "way") & F.col("tags")[tag].isNotNull())
    pair = F.expr("transform(sequence(0, size(nodes) - 2), i -> struct(i as pos, nodes[i] as u, nodes[i + 1] as v))")
    edges = ways.where("size(nodes) > 1").select(F.col("id").alias("way"), "tags", F.inline(pair)).where("u <> v")
    known = elements.where("type = 'node' and lat is not null and lon is not null").select("id", "lat", "lon")
    for end in "uv":
        edges = edges.join(known.select(F.col("id").alias(end), F.col("lat").alias(f"lat_{end}"), F.col("lon").alias(f"lon_{end}")), end)
    length = geo.haversine(*[F.col(c) for c in ("lat_u", "lon_u", "lat_v", "lon_v")])
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return known.join(ends, "id", "left_semi"), edges.select("way", "pos", "u", "v", length.alias("length"), "tags")


@dataclass
class Page(InputPartition):
    offset: int
    order: str


def _literal(value: object) -> str | None:
    """A value in a service's SQL; None for what is better compared here."""
    if isinstance(value, bool):
        return None
    if isinstance(value, int | float):
        return repr(value) if math.isfinite(value) else None
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'" if value.microsecond == 0 and value.tzinfo is None else None
    if isinstance(value, date):
        return f"DATE '{value}'"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else None


_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def filter_sql(f: Filter) -> tuple[str, bool] | None:
    """A filter in a service's SQL and whether that decides it; None if it can't be said.

    Services may compare texts without regard to case, so for texts only what can let too much through is said, and
    it is tested again here.
    """
    if isinstance(f, Not):
        inner = filter_sql(f.child)
        return (f"NOT ({inner[0]})", True) if inner and inner[1] and not isinstance(f.child, EqualNullSafe) else None
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name is None or not re.fullmatch(r"\w+", name):
        return None
    if isinstance(f, IsNull | IsNotNull):
        return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", True
    if isinstance(f, In):
        values = [_literal(v) for v in f.value if v is not None]
        return (f"{name} IN ({', '.join(values)})", not any(isinstance(v, str) for v in f.value)) if values and None not in values and len(values) == len(f.value) else None
    if isinstance(f, EqualNullSafe) and f.value is None:
        return f"{name} IS NULL", True
    sign = "=" if isinstance(f, EqualNullSafe) else _COMPARED.get(type(f))
    value = _literal(f.value) if sign else None
    if value is None or isinstance(f.value, str) and sign != "=":
        return None
    return f"{name} {sign} {value}", not isinstance(f.value, str)


class FeatureServerReader(DataSourceReader):
    """Pages of a feature service, each read by a task of its own.

    With a schema other than `value` the service is asked for its columns only, and for the rows that filters of the query let through.
    """

    def __init__(self, options: dict, schema: T.StructType | None = None):
        self.url, self.size = options["url"].rstrip("/"), int(options.get("pageSize", 2000))
        self.columns = [c for c in schema.fields] if schema is not None and schema.names != ["value"] else None
        fields = ",".join(c.name for c in self.columns if c.name != "geometry") if self.columns else "*"
        self.query = {"f": "json", "where": options.get("where", "1=1"), "outFields": options.get("outFields", fields)}
        if self.columns and "geometry" not in [c.name for c in self.columns]:
            self.query["returnGeometry"] = "false"
        if options.get("orderBy"):
            self.query["orderByFields"] = options["orderBy"]
        if options.get("bbox"):
            self.query |= {"geometry": options["bbox"], "geometryType": "esriGeometryEnvelope", "inSR": "4326"}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters become part of the service's `where`; those that it doesn't decide are left to Spark."""
        for f in filters:
            said = filter_sql(f) if self.columns and "geometry" not in getattr(f, "attribute", ()) else None
            if said:
                where = self.query["where"]
                self.query["where"] = said[0] if where == "1=1" else f"({where}) AND ({said[0]})"
            if not said or not said[1]:
                yield f

    def get(self, **more: object) -> dict:
        return self.load(f"{self.url}/query?{urllib.parse.urlencode(self.query | more)}")

    def layer(self) -> dict:
        """What the service says of itself."""
        return self.load(f"{self.url}?f=json")

    def load(self, url: str) -> dict:
        for attempt in range(4):
            try:
                with urllib.request.urlopen(url, timeout=60) as r:
                    out = json.load(r)
                if "error" in out:
                    raise ValueError(out["error"])
                return out
            except OSError:
                if attempt == 3:
                    raise
                time.sleep(2**attempt)
        raise AssertionError

    def partitions(self) -> list[InputPartition]:
        # without an order pages may overlap or skip rows
        order = self.query.get("orderByFields") or self.layer().get("objectIdField")
        if not order:
            raise ValueError("the service names no object id; give orderBy")
        n = int(self.get(returnCountOnly="true")["count"])
        return [Page(i, order) for i in range(0, n, self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        got = self.get(outSR="4326", orderByFields=partition.order, resultOffset=partition.offset, resultRecordCount=self.size)
        for feature in got.get("features", []):
            if self.columns is None:
                yield (json.dumps(feature),)
            else:
                found = feature.get("attributes", {})
                yield tuple(json.dumps(feature.get("geometry")) if c.name == "geometry" else self.cast(found.get(c.name), c.dataType) for c in self.columns)

    @staticmethod
    def cast(value: object, kind: T.DataType) -> object:
        """A JSON value as one of the schema; instants are milliseconds."""
        if value is None:
            return None
        if isinstance(kind, T.TimestampType):
            return datetime.fromtimestamp(value / 1000, UTC)
        if isinstance(kind, T.IntegralType):
            return int(value)
        return float(value) if isinstance(kind, T.FractionalType) else str(value) if isinstance(kind, T.StringType) else value


class FeatureServer(DataSource):
    """spark.read.format("featureserver"): a feature service's rows as JSON; where, outFields, orderBy and bbox are the server's work."""

    @classmethod
    def name(cls) -> str:
        return "featureserver"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FeatureServerReader(self.options, schema)


def feature_server(spark: SparkSession, url: str, schema: str | None = None, **options: object) -> DataFrame:
    """A feature service as a table of the columns in `schema` (DDL; `geometry` as JSON text), or of whole features as JSON.

    The service is asked only for those columns, and filters on them become its `where`, so that a DataFrame's filter
    decides what is sent. Columns that a query does not select but the schema names are sent all the same: Spark prunes no
    columns of Python sources.
    """
    spark.dataSource.register(FeatureServer)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("featureserver").options(url=url, **options)
    return (reader.schema(schema) if schema else reader).load()
