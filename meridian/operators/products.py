"""What the library answers: one place, one hour, one area, one path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meridian.functions import geo, text
from meridian.operators import scoring


def segment_detail(segments: DataFrame, cells: DataFrame, asked: DataFrame, spatial: list[str], temporal: list[str], q: DataFrame, top: int = 5) -> DataFrame:
    """One row per ask (key, seg, cell): score, band and the factors that make it up, in whole points.

    `segments` has seg, base and the spatial factors, `cells` (a fixed set of kinds of hour)
    cell and the temporal ones, `q` one row with the quantile table.
    """
    rows = asked.join(segments, "seg").join(F.broadcast(cells), "cell").join(F.broadcast(q))
    told = scoring.attribute(F.col("base"), {n: F.col(n) for n in [*spatial, *temporal]}, F.col("q"), top)
    out = rows.select("key", "seg", "cell", told.alias("a"))
    return out.select("key", "seg", "cell", "a.score", text.band(F.col("a.score")).alias("band"), "a.baseline", "a.factors", "a.remainder")


def area_detail(points: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """`points` (id, x, y) with the columns of the hexagon (q, r) that each lies in; points outside the grid drop out."""
    q, r = geo.hex_cell(F.col("x"), F.col("y"), size)
    return points.withColumns({"q": q, "r": r}).join(areas, ["q", "r"])


def area_log_rate(shares: DataFrame, multipliers: DataFrame, key: list[str]) -> DataFrame:
    """(key, cell, log_rate): log of the mean multiplier of an area's road groups by their share, floored at 1e-12."""
    both = shares.join(F.broadcast(multipliers), "group")  # groups by kinds of hour: a fixed set
    return both.groupBy(*key, "cell").agg(F.ln(F.greatest(F.lit(1e-12), F.sum(F.col("share") * F.col("multiplier")))).alias("log_rate"))


def area_answers(asked: DataFrame, areas: DataFrame, rates: DataFrame, factors: list[str], q: DataFrame, size: float, top: int = 4) -> DataFrame:
    """(key, q, r, cell, score, band, baseline, factors, remainder): what makes up the score of the hexagon that each ask lies in, at its kind of hour.

    `asked` has key, x, y and cell, `areas` q, r, base and the area's own factors, `rates` q, r, cell and log_rate, the hour's factor (see
    `area_log_rate`), which counts as time_of_week; `q` is one row with the quantile table. Asks outside the areas, or without a rate for their cell, have no row.
    """
    at = area_detail(asked, areas, size).join(rates.select("q", "r", "cell", F.col("log_rate").alias("time_of_week")), ["q", "r", "cell"])
    rows = at.join(F.broadcast(q.withColumnRenamed("q", "__table")))
    told = scoring.attribute(F.col("base"), {n: F.col(n) for n in [*factors, "time_of_week"]}, F.col("__table"), top)
    out = rows.select("key", "q", "r", "cell", told.alias("a"))
    return out.select("key", "q", "r", "cell", "a.score", text.band(F.col("a.score")).alias("band"), "a.baseline", "a.factors", "a.remainder")


def identity_gap(df: DataFrame, decomposed: Column, direct: Column) -> DataFrame:
    """(gap): the largest difference between a decomposed and a direct log density; above 1e-6 the explanation is wrong."""
    return df.agg(F.max(F.abs(decomposed - direct)).alias("gap"))


def route_answer(chosen: DataFrame) -> DataFrame:
    """`chosen` paths (t0, e0, duration, exposure, status, shown) with reduction_pct (null if none is shown or none is gained), extra_s and a message code.

    The message is the status itself where it tells of no path, else whether a lower risk was found.
    """
    gain = F.rint((1 - F.col("exposure") / F.nullif(F.col("e0"), F.lit(0.0))) * 100).cast("int")
    code = F.when(F.col("status").isin("too_close", "no_connection"), F.col("status")).when(F.col("shown"), "lower_risk_found").otherwise("already_lowest")
    extra = F.rint(F.col("duration") - F.col("t0")).cast("int")
    return chosen.withColumns({"reduction_pct": F.when(F.col("shown") & (gain > 0), gain), "extra_s": extra, "message": code})


def route_reports(reports: DataFrame, paths: DataFrame, segments: DataFrame) -> DataFrame:
    """(query, report columns, x, y): the reports on each path's segments, each once, at the place that the network has for the segment.

    `reports` has seg, `paths` query and seg, `segments` seg, x and y; reports of an unknown segment are dropped.
    """
    on = paths.select("query", "seg").distinct()
    return reports.drop("x", "y").join(on, "seg").join(segments.select("seg", "x", "y"), "seg").select("query", *[c for c in reports.columns if c not in ("x", "y")], "x", "y")


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """A number with its word, in the singular for 1; null for none."""
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s")))


def told(parts: list[Column], between: str = ", ") -> Column:
    """The parts that are known, in order, as one text; null if none is."""
    return F.nullif(F.concat_ws(between, *parts), F.lit(""))


def suggestions(found: DataFrame, catalog: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, suggestions): what `catalog` (factor, suggestion; a fixed set) says of each key's factors, strongest first, each text once.

    `found` has key and factors (array of names, strongest first). Factors without an entry and
    null names say nothing; a key of which nothing is said keeps an empty list. A suggestion
    takes the place of the strongest factor that has it.
    """
    named = found.select(key, F.posexplode("factors").alias("at", "factor")).join(F.broadcast(catalog), "factor")
    first = named.groupBy(key, "suggestion").agg(F.min("at").alias("at"))
    listed = first.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "suggestion"))), 1, most).alias("s"))
    return found.select(key).join(listed, key, "left").select(key, F.coalesce("s.suggestion", F.expr("cast(array() as array<string>)")).alias("suggestions"))


def evidence(score: Column, factors: Column, most: int = 3) -> Column:
    """Nested evidence for a text: score, band, and the factors (name, points) that raise and lower it most."""
    ranked = lambda up: F.slice(F.filter(factors, lambda f: (f["points"] > 0) if up else (f["points"] < 0)), 1, most)
    return F.struct(score.alias("score"), text.band(score).alias("band"), ranked(True).alias("raising"), ranked(False).alias("lowering"))


def sentence(place: Column, told: Column) -> Column:
    """A plain sentence from evidence; parts without content are left out."""
    names = lambda c: F.array_join(F.transform(c, lambda f: text.humanize(f["name"])), ", ")
    up = F.when(F.size(told["raising"]) > 0, F.concat(F.lit("raised by "), names(told["raising"])))
    down = F.when(F.size(told["lowering"]) > 0, F.concat(F.lit("lowered by "), names(told["lowering"])))
    return F.concat(F.concat_ws(", ", F.concat(place, F.lit(" scores "), told["score"].cast("string"), F.lit(" of 100")), up, down), F.lit("."))
