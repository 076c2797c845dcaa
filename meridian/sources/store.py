"""Tables that batches are applied to, each at most once, by rewriting only the parts that a batch touches.

A store is a folder. Its rows lie in parts, by the column `part`. A version of it is one small
file that names, for each part, the folder which holds that part and the batch it is of.
Applying a batch writes the touched parts under the batch's own number, then the new version.
A batch that is not newer than the version is passed over, so replaying one changes nothing;
a batch that failed half-way is written over when it comes again. Readers see whole versions,
and parts that no batch touches keep their files.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Makes the new rows of some parts from their old ones and a batch; both have `part`.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Store:
    """A table under `root` with the columns of `schema` (DDL) and part (string)."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("part", T.StringType())])

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def versions(self) -> DataFrame:
        """(n, part, folder, batch): all versions, numbered from 1."""
        schema = "part string, folder string, batch long, n long"
        if not self._exists(f"{self.root}/versions"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/versions")

    def current(self) -> tuple[int, int, dict[str, str]]:
        """The newest version's number, its batch, and the folder of each part: metadata, one entry a part."""
        v = self.versions()
        newest = v.agg(F.max("n")).first()[0]
        if newest is None:
            return 0, -1, {}
        rows = v.where(F.col("n") == newest).collect()
        return newest, max(r["batch"] for r in rows), {r["part"]: r["folder"] for r in rows if r["part"] is not None}

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The rows of the newest version, of all parts or of some."""
        folders = self.current()[2]
        paths = [f for p, f in folders.items() if parts is None or p in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/rows").parquet(*paths).select(*self.schema.names)

    def apply(self, changes: DataFrame, batch: int, merge: Merge) -> bool:
        """Apply a batch; False if it, or a newer one, has been. `changes` has part; a null part goes."""
        n, done, folders = self.current()
        if batch <= done:
            return False
        changes = changes.where("part is not null")
        touched = sorted(r["part"] for r in changes.select("part").distinct().collect())  # names of parts, not rows
        if odd := [p for p in touched if not re.fullmatch(r"[\w.-]+", p, re.ASCII)]:
            raise ValueError(f"parts are names of letters, digits, '_', '.' and '-': {odd[:3]}")
        if touched:
            rows = merge(self.read(touched), changes).select(*self.schema.names)
            rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/rows/batch={batch}")
        folders |= {p: f"{self.root}/rows/batch={batch}/part={p}" for p in touched}
        entries = [(p, f, batch) for p, f in sorted(folders.items())] or [(None, None, batch)]
        version = self.spark.createDataFrame(entries, "part string, folder string, batch long").coalesce(1)
        version.write.mode("overwrite").parquet(f"{self.root}/versions/n={n + 1}")
        return True


def key_part(keys: list[str], parts: int) -> Column:
    """The part of a row by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string")


def upsert(store: Store, changes: DataFrame, batch: int, keys: list[str], parts: int = 16, stamp: str | None = None, order: list[Column] | None = None) -> bool:
    """Insert or replace rows by key.

    Of several changes of a key in a batch the last in `order` counts (all their columns, if not given). With
    `stamp`, a change has `expected`: it is taken only if the row's stamp is still that, or, for a
    null, if there is no row. A change whose expectation fails is dropped. `parts` must stay the same for a store. Null
    keys are a value like any other.
    """
    columns = [c for c in store.schema.names if c != "part"]
    fit = changes.withColumn("part", key_part(keys, parts))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        tell = F.struct(*order) if order else F.struct(*columns)
        last = new.groupBy("part", *keys).agg(F.max_by(F.struct(*columns, *(["expected"] if stamp else [])), tell).alias("new"))
        a, b = old.select(F.struct(*columns).alias("old"), "part", *[F.col(k).alias(f"__{k}") for k in keys]), last
        on = a["part"] == b["part"]
        for k in keys:
            on = on & a[f"__{k}"].eqNullSafe(b[k])
        both = a.join(b, on, "full").select(F.coalesce(a["part"], b["part"]).alias("part"), "old", "new")
        takes = F.col("new").isNotNull()
        if stamp:
            takes = takes & F.col("new.expected").eqNullSafe(F.col(f"old.{stamp}"))
        out = both.select("part", *[F.when(takes, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns], (takes | F.col("old").isNotNull()).alias("__there"))
        return out.where("__there").drop("__there")

    return store.apply(fit, batch, merge)


def upsert_sink(store: Store, keys: list[str], parts: int = 16, stamp: str | None = None, order: list[Column] | None = None) -> Callable[[DataFrame, int], None]:
    """`upsert` as the function of a stream's foreachBatch; a stream that starts again after a failure repeats its last batch, which is taken once."""

    def put(changes: DataFrame, batch: int) -> None:
        changes.persist()
        try:
            upsert(store, changes, batch, keys, parts, stamp, order)
        finally:
            changes.unpersist()

    return put


def refresh(store: Store, rows: DataFrame, batch: int, keys: list[str], sums: list[str], part: Column) -> bool:
    """Add a batch of rows to a rollup: `sums` by `keys`, kept in parts by `part`, which follows from the keys.

    The batch is summed first; only the parts that it touches are read, added to and written,
    however late its rows are.
    """
    partial = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("part", part.cast("string"))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.select("part", *keys, *sums).unionByName(new.select("part", *keys, *sums))
        return both.groupBy("part", *keys).agg(*[F.sum(c).alias(c) for c in sums])

    return store.apply(partial, batch, merge)
