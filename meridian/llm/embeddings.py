"""Embedding near-dedup by PCA-ordered tiled comparison.

The axes are turned to the principal axes of the second moments, strongest first, which
changes no cosine. Rows are dealt into tiles by the cells of their leading coordinates.
Tiles whose boxes over the leading axes lie too far apart for the threshold are never
compared. Within a pair of tiles, products are accumulated over slabs of leading axes; the
rest can add no more than the product of the two suffix norms, and pairs that cannot reach
the threshold any more stop there. What is left is decided by the cosine of the original
vectors in double precision.

Neighbouring tiles form groups, and a task takes two groups with all their tiles. So a tile
travels once for each group near its own instead of once for each tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from meridian.llm.text import local_components
from meridian.operators.graph import connected_components
from meridian.plans.scratch import Scratch

THRESHOLD = 0.95
#: Bytes of a tile's vectors, and tiles of a group at most.
TILE, GROUP = 4 << 20, 16
#: Axes after which products are bounded.
SLABS = (12, 24, 40)
#: Rows of a tile that are multiplied at once.
STRIPE = 512
#: Leading axes whose cells deal out the rows, and those of a tile's box.
CELLS, BOX = 3, 8
#: Lengths of vectors that get axes of their own, the most frequent first; for the others any axes are as right.
LENGTHS = 16
#: Components of vectors whose axes are found, at most: 8 MB of axes a length.
LONGEST = 1024


def _matrix(column: pd.Series) -> np.ndarray:
    """The vectors as rows, each times the power of two that brings its largest component near one, which changes no cosine."""
    x = np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def principal_axes(vectors: DataFrame, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each length of vectors, orthonormal axes (columns) of the unit vectors' second moments, strongest first.

    Tasks add up their own moments, and a group for each line of the matrix those of the tasks; the driver gets a line of
    numbers for each component. Lengths over LONGEST have no entry: for them the components are the axes.
    """
    sizes = [n for n in sizes if n <= LONGEST]

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {n: np.zeros((n, n)) for n in sizes}
        for f in frames:
            for n, g in f.groupby("n"):
                x = _matrix(g["v"])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total[n] += x.T @ x
        for n, m in total.items():
            if m.any():
                yield pd.DataFrame({"n": n, "i": np.arange(n), "line": [r.tobytes() for r in m]})

    def added(g: pd.DataFrame) -> pd.DataFrame:
        lines = sorted(g["line"])  # in one order, whatever task came first
        return pd.DataFrame({"n": g["n"].iloc[:1], "i": g["i"].iloc[:1], "line": [np.sum([np.frombuffer(x) for x in lines], axis=0).tobytes()]})

    some = vectors.where(F.col("n").isin(sizes)).select("n", "v")
    schema = "n int, i int, line binary"
    rows = some.mapInPandas(moments, schema).groupBy("n", "i").applyInPandas(added, schema).toPandas()
    return {int(n): np.linalg.eigh(np.stack([np.frombuffer(x) for x in g.sort_values("i")["line"]]))[1][:, ::-1] for n, g in rows.groupby("n")}


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i of a, j of b) with cosine >= threshold; i < j if both are the same tile."""
    size = a.shape[1]
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    ra, rb = (ua @ axes).astype(np.float32), (ub @ axes).astype(np.float32)
    ends = [e for e in SLABS if e < size] + [size]
    # norms of what follows each slab, a little too long so that single precision loses no pair
    na, nb = (np.stack([np.sqrt((r[:, e:].astype(np.float64) ** 2).sum(axis=1)) for e in ends]).astype(np.float32) for r in (ra, rb))
    bar = np.float32(threshold - 1e-4)
    for top in range(0, len(a), STRIPE):
        s = slice(top, top + STRIPE)
        first = top if same else 0
        dot = ra[s, : ends[0]] @ rb[first:, : ends[0]].T
        i, j = np.nonzero(dot + na[0, s, None] * nb[0, None, first:] >= bar)
        part = dot[i, j]
        i, j = i + top, j + first
        if same:
            part, i, j = part[i < j], i[i < j], j[i < j]
        for t, (lo, hi) in enumerate(zip(ends, ends[1:]), 1):
            step = np.empty(len(i), np.float32)
            for k in range(0, len(i), 1 << 18):
                q = slice(k, k + (1 << 18))
                step[q] = np.einsum("ij,ij->i", ra[i[q], lo:hi], rb[j[q], lo:hi])
            part = part + step
            keep = part + na[t, i] * nb[t, j] >= bar
            part, i, j = part[keep], i[keep], j[keep]
        for k in range(0, len(i), 1 << 17):
            p, q = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            norms = np.linalg.norm(a[p], axis=1) * np.linalg.norm(b[q], axis=1)
            sure = np.einsum("ij,ij->i", a[p], b[q]) / norms >= threshold
            yield p[sure], q[sure]


def _apart(a: pd.Series, b: pd.Series, threshold: float) -> bool:
    """Whether no vectors of the two tiles' boxes can link: unit vectors with that cosine lie within sqrt(2 - 2 * threshold)."""
    gap = np.maximum(0, np.maximum(np.subtract(a.lo, b.hi), np.subtract(b.lo, a.hi)))
    return a.n != b.n or float(gap @ gap) > 2 - 2 * threshold + 1e-9


def _tile_links(a: pd.Series, b: pd.Series, axes: np.ndarray, threshold: float) -> pd.DataFrame:
    """(node, links, root) of the links between two tiles, or within one; root joins the linked nodes."""
    same = a.tile == b.tile
    tiles = [a] if same else [a, b]
    ids, many = ([np.frombuffer(t[c], np.int64) for t in tiles] for c in ("ids", "many"))
    data = [np.frombuffer(t["data"], np.float64).reshape(-1, a.n) for t in tiles]
    node = np.concatenate(ids)
    shift = 0 if same else len(ids[0])
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    for i, j in close_pairs(data[0], data[-1], axes, threshold, same):
        links += np.bincount(i, many[-1][j], len(node)).astype(np.int64)
        links += np.bincount(j + shift, many[0][i], len(node)).astype(np.int64)
        label = local_components(len(node), i, j + shift, label)
    hit = np.flatnonzero(links)
    return pd.DataFrame({"node": node[hit], "links": links[hit], "root": node[label[hit]]})


def _group_links(frames: Iterator[pd.DataFrame], axes: Broadcast, threshold: float) -> Iterator[pd.DataFrame]:
    """The links between the tiles of each two groups (gi, gj) of a partition sorted by them."""

    def compared(held: list[pd.Series]) -> Iterator[pd.DataFrame]:
        of_i, of_j = ([t for t in held if t.g == g] for g in (held[0].gi, held[0].gj))
        for a in of_i:
            for b in of_j:
                if (held[0].gi != held[0].gj or a.tile <= b.tile) and not _apart(a, b, threshold):
                    yield _tile_links(a, b, axes.value.get(a.n, np.eye(a.n)), threshold)

    held: list[pd.Series] = []
    for f in frames:
        for _, t in f.iterrows():
            if held and (held[0].gi, held[0].gj) != (t.gi, t.gj):
                yield from compared(held)
                held = []
            held.append(t)
    if held:
        yield from compared(held)


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, vec: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id and the column `vec`).

    n_links counts the other rows with cosine >= threshold, component_id is the smallest
    vec_id reachable by links, kept tells whether that is the row itself. Equal vectors are
    compared once. Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, and so do vectors of different lengths with each other. Rows that
    repeat a vec_id with other vectors are reachable from each other, each with its own
    n_links. Rows with a null vec_id link with nothing and are kept (component_id null). An
    empty table gives an empty result. Extra columns are ignored. `tile` is the bytes of a
    tile; it decides no result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select("vec_id", F.col(vec).cast("array<double>").alias("v"))
    finite = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    sound = F.expr(f"coalesce({finite}, false) and vec_id is not null")
    keyed = rows.where(sound).select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    nodes = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("v").alias("v"))
    nodes = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "*", F.size("v").alias("n")))
    counts = nodes.groupBy("n").count().orderBy(F.desc("count"), "n")
    sizes = [r["n"] for r in counts.limit(LENGTHS).collect()]
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = spark.sparkContext.broadcast(principal_axes(nodes, sizes))
    of_tile = lambda n: max(1, tile // (8 * n))
    parts = sum(-(-r["count"] // of_tile(r["n"])) for r in counts.where(F.col("n").isin(sizes)).collect()) + int(counts.count() > LENGTHS)

    def leading(n: int, x: np.ndarray, many: int) -> np.ndarray:
        """Coordinates of the unit vectors on the first axes, as many as asked for."""
        c = np.zeros((len(x), many))
        known = (axes.value[n] if n in axes.value else np.eye(n, many))[:, :many]
        c[:, : known.shape[1]] = x @ known / np.linalg.norm(x, axis=1, keepdims=True)
        return c

    # unit vectors with this cosine differ by at most `reach` in any coordinate
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, g in f.groupby("n"):
                x = _matrix(g["v"])
                cells = np.floor(leading(n, x, CELLS) / reach).astype(np.int64)
                yield pd.DataFrame({"node": g["node"], "many": g["many"], "n": n, "cell": list(cells), "data": [r.tobytes() for r in x]})

    dealt = nodes.select("node", "many", "n", "v").mapInPandas(placed, "node long, many long, n int, cell array<long>, data binary")
    dealt = dealt.repartitionByRange(parts, "n", *[F.col("cell")[i] for i in range(CELLS)], "node")
    # groups of tiles are as large as leaves each of the shuffle's partitions some pair of them
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = max(1, min(GROUP, int(parts / np.sqrt(2 * n))))

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId(), 0
        f = pd.concat(list(frames), ignore_index=True)
        for size, g in f.groupby("n"):
            g = g.sort_values(["cell", "node"], key=lambda c: c.map(tuple) if c.name == "cell" else c)
            for at in range(0, len(g), 2 * of_tile(size)):
                t = g.iloc[at : at + 2 * of_tile(size)]
                data = b"".join(t["data"])
                c = leading(size, np.frombuffer(data, np.float64).reshape(-1, size), BOX)
                ids, many = (t[x].to_numpy(np.int64).tobytes() for x in ("node", "many"))
                box = {"lo": [c.min(axis=0)], "hi": [c.max(axis=0)]}
                yield pd.DataFrame({"tile": (part << 32) + k, "g": part // together, "n": size, **box, "ids": [ids], "many": [many], "data": [data]})
                k += 1

    schema = "tile long, g long, n int, lo array<double>, hi array<double>, ids binary, many binary, data binary"
    tiles = scratch.write(dealt.mapInPandas(gather, schema))
    boxes = tiles.select("g", "n", "lo", "hi")
    # boxes that lie near each other share a cell of the leading axes, or have cells next to each other
    cells = [f"b{k}" for k in range(CELLS)]

    def spread(df: DataFrame, by: int) -> DataFrame:
        for k, b in enumerate(cells):
            df = df.select("*", F.explode(F.sequence(F.floor(F.col("lo")[k] / reach) - by, F.floor(F.col("hi")[k] / reach) + by)).alias(b))
        return df

    i = spread(boxes, 0).select("n", *cells, F.col("g").alias("gi"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    j = spread(boxes, 1).select("n", *cells, F.col("g").alias("gj"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    gap = "zip_with(zip_with(lo_i, hi_j, (x, y) -> x - y), zip_with(lo_j, hi_i, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D))"
    far = F.expr(f"aggregate({gap}, 0D, (s, x) -> s + x * x)")
    pairs = i.join(j, ["n", *cells]).where((F.col("gi") <= F.col("gj")) & (far <= reach * reach)).select("gi", "gj").distinct()
    work = pairs.select("gi", "gj", F.explode(F.array_distinct(F.array("gi", "gj"))).alias("g")).join(tiles, "g")
    work = work.repartition(n, "gi", "gj").sortWithinPartitions("gi", "gj", "tile")
    found = scratch.write(work.mapInPandas(lambda fs: _group_links(fs, axes, threshold), "node long, links long, root long"))
    of_row = scratch.write(keyed.select("vec_id", "k1", "k2").join(nodes.select("k1", "k2", "node", "many", "least"), ["k1", "k2"]).drop("k1", "k2"))
    again = of_row.groupBy("vec_id").agg(F.min("node").alias("root"), F.max("node").alias("most")).where("root <> most").select("vec_id", "root")
    edges = found.select("node", "root").unionByName(of_row.join(again, "vec_id").select("node", "root")).where("node <> root")
    parts_of = scratch.write(connected_components(edges, "node", "root"))
    named = nodes.join(parts_of, "node").groupBy("component").agg(F.min("least").alias("name"))
    named = parts_of.join(scratch.write(named), "component").select("node", "name")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = scratch.write(nodes.select("node").join(links, "node", "left").join(named, "node", "left").where("links is not null or name is not null"))
    of_row = of_row.join(known, "node", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")
    done = of_row.select("vec_id", n_links, F.coalesce("name", "least").alias("component_id"))
    rest = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
