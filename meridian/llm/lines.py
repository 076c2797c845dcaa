"""Line dedup by winnowing, in DataFrame functions only.

In every window of `lines` consecutive lines the line with the least hash is selected.
The choice depends on the window alone, so two equal windows select the same line at the
same place: the selected lines are fingerprints that no run of at least `lines` equal
lines can escape. A fingerprint is kept as its position and the hashes of the lines around
it; those that occur once drop out. The positions of the others are joined through the
windows that select them, each to the earliest position with the same window, which
extends a match both ways as far as lines agree with any earlier place. Lines of `words`
words or more, and whole documents of fewer than `lines` lines, are windows of their own.
Matches that touch form a run; of equal runs all but the earliest are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meridian.plans.scratch import Scratch

LINES = 3
#: Words of a line that is compared by itself.
WORDS = 8

#: The text that tells rows of one doc_id apart, and two hashes of it or of a line that don't follow from each other.
_TEXT = "xxhash64(text)"
_PAIR = "xxhash64({0}), xxhash64(1, {0})"


def _fingerprints(hashed: DataFrame, lines: int) -> DataFrame:
    """(doc_id, v, p, fp, first, around): each selected line, and the hashes of the lines from `first` that its windows span."""
    place = f"j - array_min(transform(slice(h, j + 1, {lines}), (x, o) -> struct(x as h, -o as o))).o"
    selected = f"array_distinct(transform(sequence(0, size(h) - {lines}), j -> {place}))"
    first = f"greatest(0, p - {lines - 1})"
    around = f"slice(h, {first} + 1, least(size(h), p + {lines}) - {first})"
    each = hashed.where(F.size("h") >= lines)
    return each.select("doc_id", "v", F.expr(f"inline(transform({selected}, p -> struct(p, h[p] as fp, {first} as first, {around} as around)))"))


def _passages(docs: DataFrame, lines: int, words: int, scratch: Scratch) -> DataFrame:
    """(doc_id, v, start, n, key): runs of n lines that are compared; equal keys are equal runs."""
    split = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.expr(_TEXT).alias("v"), F.split("text", "\n", -1).alias("l"))
    hashed = split.withColumn("h", F.expr("transform(l, x -> xxhash64(x))"))
    found = scratch.write(_fingerprints(hashed, lines))
    repeated = scratch.write(found.groupBy("fp").count().where("count > 1").select("fp"))
    ours = f"array_min(transform(slice(around, j + 1, {lines}), (x, o) -> struct(x as h, -o as o))).o = j + first - p"
    windows = f"filter(sequence(0, size(around) - {lines}), j -> {ours})"
    windows = f"transform({windows}, j -> struct(first + j as start, {lines} as n, slice(around, j + 1, {lines}) as key))"
    windows = found.join(repeated, "fp", "left_semi").select("doc_id", "v", F.expr(f"inline({windows})"))
    long = f"filter(transform(l, (x, i) -> struct(i as start, x)), y -> regexp_count(y.x, '[^\\\\x20\\\\x09-\\\\x0D]+') >= {words})"
    single = split.select("doc_id", "v", F.expr(f"inline(transform({long}, y -> struct(y.start, 1 as n, array({_PAIR.format('y.x')}) as key)))"))
    short = split.where((F.size("l") < lines) & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    whole = short.select("doc_id", "v", F.lit(0).alias("start"), F.size("l").alias("n"), F.expr(f"array({_PAIR.format('text')}, 0, 0)").alias("key"))
    out = scratch.write(windows.unionByName(single).unionByName(whole))
    scratch.free(found, repeated)
    return out


def repeated_runs(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """(doc_id, v, first, last): the runs of lines (from 0, both ends included) that occurred earlier.

    A line is in a run if it is covered by a window that also starts earlier: in a document
    with a smaller (doc_id, v), or before in the same one. A window is `lines` lines, one
    line of at least `words` words, or all of a document that has fewer than `lines` lines
    and has anything but white space. v is a hash of the text, which tells rows of one doc_id apart.
    """
    scratch = Scratch(docs.sparkSession)
    passages = _passages(docs, lines, words, scratch)
    least = passages.groupBy("key").agg(F.min(F.struct("doc_id", "v", "start")).alias("least"), F.max(F.struct("doc_id", "v", "start")).alias("most"))
    least = scratch.write(least.where("least <> most").select("key", "least"))
    later = passages.join(least, "key").where("least < struct(doc_id, v, start)").select("doc_id", "v", "start", "n")
    of_doc = Window.partitionBy("doc_id", "v").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(of_doc))
    return runs.groupBy("doc_id", "v", "run").agg(F.min("start").alias("first"), (F.max(F.col("start") + F.col("n")) - 1).alias("last")).drop("run")


def line_dedup(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """`docs` with text less its repeated runs, n_lines, n_removed and removed (the runs).

    Lines end at '\\n' only. A null text has no lines and stays null; an empty text is one
    empty line. Rows with a null doc_id stay as they are and are compared with nothing. Rows
    of one doc_id with different texts are documents of their own, ordered by a hash of the
    text; rows that repeat both get equal results. Columns of `docs` named like an added one
    are replaced, others pass through. An empty table gives an empty result.
    """
    runs = repeated_runs(docs, lines, words).groupBy(F.col("doc_id").alias("__d"), F.col("v").alias("__v"))
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__removed"))
    docs = docs.drop("n_lines", "n_removed", "removed")
    joined = docs.join(runs, (F.col("doc_id") == F.col("__d")) & (F.expr(_TEXT) == F.col("__v")), "left").withColumn("__l", F.split("text", "\n", -1))
    parts = """flatten(transform(sequence(0, size(__removed)), r ->
        slice(__l, if(r = 0, 0, __removed[r - 1].last + 1) + 1,
              if(r = size(__removed), size(__l), __removed[r].first) - if(r = 0, 0, __removed[r - 1].last + 1))))"""
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(F.expr(parts), "\n"))
    gone = F.expr("aggregate(__removed, 0, (n, r) -> n + r.last - r.first + 1)")
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__l")).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("__removed", F.expr("cast(array() as array<struct<first:int,last:int>>)")).alias("removed"),
    )


SQL = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL),
line AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM cut),
three AS (SELECT doc_id, i, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
nth AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM three WHERE c IS NOT NULL),
one AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS n FROM line WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 8),
short AS (SELECT doc_id, len(l) AS lines, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM cut WHERE len(l) < 3 AND regexp_matches(text, '[^\x20\x09-\x0D]')),
gone AS (SELECT doc_id, i + o AS i FROM nth, (VALUES (0), (1), (2)) AS t(o) WHERE n > 1
         UNION SELECT doc_id, i FROM one WHERE n > 1
         UNION SELECT doc_id, unnest(range(1, lines + 1)) FROM short WHERE n > 1)
SELECT d.doc_id, count(line.i) AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(line.line, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN line ON line.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.i = line.i
GROUP BY d.doc_id
"""
