"""Text, tag and label functions: Columns in, Columns out, null where a value can't be read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
TRUE_WORDS = ["true", "1", "yes"]
LIT_TAGS = ["yes", "24/7", "automatic", "sunset-sunrise", "dusk-dawn"]
UNLIT_TAGS = ["no", "disused"]
ROAD_HIGHWAYS = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "road",
]
ARTERIALS = ["motorway", "trunk", "primary", "secondary"]
COLLECTORS = ["tertiary", "unclassified"]
CYCLEWAY_CLASS = {
    "track": 3, "separate": 3, "lane": 2, "buffered_lane": 2, "opposite_lane": 2, "opposite_track": 3,
    "shared_lane": 1, "share_busway": 1, "opposite_share_busway": 1,
}
CITY_FACILITY_CLASS = {
    "protected bike lane": 3, "shared-use path": 3, "painted bike lane": 2, "painted bike lanes": 2, "bike-friendly street": 1,
}
CYCLEWAY_KEYS = ["cycleway", "cycleway:left", "cycleway:right", "cycleway:both"]
TRAIL_NAMES = r"(?i)belt\s?line|eastside trail|westside trail|southside trail"
BANNED_TERMS = [
    "safe", "safest", "safer", "safety", "guarantee", "guaranteed", "crime", "criminal", "dangerous area", "dangerous neighborhood",
    "bad neighborhood", "bad area", "sketchy", "unsafe", "violent", "shooting", "robbery", "income", "race", "demographic",
]
NUMBER = r"(?<![\w.])(\d+(?:\.\d+)?)(?!\w)"
BANDS = [(75, "High"), (50, "Elevated"), (25, "Moderate")]


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def severity_letter(c: Column) -> Column:
    """K, A, B, C or O from '(K) Fatal Injury'; null for anything else."""
    return F.nullif(F.regexp_extract(c, r"^\(([KABCO])\)", 1), F.lit(""))


def digits_only(c: Column) -> Column:
    """The trimmed value if it is all digits."""
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c))


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def truthy(c: Column) -> Column:
    """True for a true word in any case; null is false."""
    return F.coalesce(F.lower(c.cast("string")).isin(TRUE_WORDS), F.lit(False))


def contains(c: Column, part: str) -> Column:
    """Whether a text holds `part`; null is false."""
    return F.coalesce(c.contains(part), F.lit(False))


def tag_values(c: Column) -> Column:
    """The parts of a ';' list, trimmed, in lower case, without empty ones; null gives none."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return parts


def facility_class(tags: Column) -> Column:
    """Strongest cycling facility (0 to 3) of a map of way tags."""
    highway, bicycle = tag_values(tags["highway"]), tag_values(tags["bicycle"])
    named = F.flatten(F.array(*[tag_values(tags[k]) for k in CYCLEWAY_KEYS]))
    best = F.array_max(F.transform(named, lambda v: F.coalesce(_map(CYCLEWAY_CLASS)[v], F.lit(0))))
    apart = F.array_contains(highway, "cycleway") | (F.array_contains(highway, "path") & F.array_contains(bicycle, "designated"))
    return F.when(apart, 3).otherwise(F.coalesce(best, F.lit(0)))


def city_facility_class(kind: Column, status: Column) -> Column:
    """Class of a city facility; only what exists counts."""
    return F.when(F.trim(status) == "Existing", F.coalesce(_map(CITY_FACILITY_CLASS)[F.lower(F.trim(kind))], F.lit(0))).otherwise(0)


def is_trail(name: Column) -> Column:
    return F.coalesce(name.rlike(TRAIL_NAMES), F.lit(False))


def _bases(highway: Column) -> Column:
    return F.transform(tag_values(highway), lambda h: F.regexp_replace(h, "_link$", ""))


def _any_of(values: Column, names: list[str]) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, names)))


def edge_kind(highway: Column, footway: Column) -> Column:
    """crossing, road or path."""
    return F.when(F.coalesce(footway, F.lit("")) == "crossing", "crossing").when(_any_of(_bases(highway), ROAD_HIGHWAYS), "road").otherwise("path")


def road_group(highway: Column) -> Column:
    """arterial before collector before local."""
    return F.when(_any_of(_bases(highway), ARTERIALS), "arterial").when(_any_of(_bases(highway), COLLECTORS), "collector").otherwise("local")


def lit_tag(c: Column) -> Column:
    """1 lit, 0 unlit, -1 unknown."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(LIT_TAGS), 1).when(v.isin(UNLIT_TAGS), 0).otherwise(-1)


def band(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    for bar, name in BANDS[1:]:
        out = out.when(score >= bar, name)
    return F.when(score.isNotNull(), out.otherwise("Lower"))


def distance_label(m: Column) -> Column:
    """'340 m' to the nearest ten, '1.2 km' from a kilometre on."""
    tens = (F.floor(m / 10 + 0.5) * 10).cast("long")
    return F.when(m < 1000, F.concat(tens.cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_number(m / 1000, 1), F.lit(" km")))


def canonical_key(*parts: Column, length: int = 16) -> Column:
    """A prefix of the SHA-256 of the parts joined by '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def clean_text(c: Column, length: int = 80) -> Column:
    """Control characters out, white space runs to one space, cut to `length`."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), r"\s+", " ")
    return F.substring(F.trim(plain), 1, length)


def sentence_count(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), r"[.!?]+(?:\s|$)", -1)
    return F.size(F.filter(parts, lambda x: F.trim(x) != ""))


def numbers_in(c: Column) -> Column:
    """Numbers that stand by themselves, as doubles in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double"))


def number_variants(x: Column) -> Column:
    """A number and the ways it may be quoted: one decimal, whole, and a share as per cent."""
    forms = F.array(x, F.round(x, 1), F.round(x, 0), F.when(F.abs(x) <= 1, F.round(x * 100, 0)))
    return F.array_distinct(F.array_compact(forms))


def banned_pattern(terms: list[str]) -> str:
    return r"(?i)\b(" + "|".join(terms) + r")(?:e?s)?\b"


def banned_terms(c: Column, terms: list[str] = BANNED_TERMS) -> Column:
    """Banned terms in a text, lower case, sorted, each once."""
    found = F.regexp_extract_all(c, F.lit(banned_pattern(terms)), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def has_link(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)https?://|www\."), F.lit(False))


def text_errors(c: Column, allowed_numbers: Column | None = None, max_chars: int = 420, max_sentences: int = 3) -> Column:
    """Codes of what is wrong with a text: too_long, too_many_sentences, banned:…, link, unknown_number:…"""
    none = F.expr("cast(array() as array<string>)")
    unknown = none
    if allowed_numbers is not None:
        loose = F.filter(numbers_in(c), lambda x: ~F.array_contains(F.coalesce(allowed_numbers, F.expr("cast(array() as array<double>)")), x))
        unknown = F.transform(F.array_distinct(loose), lambda x: F.concat(F.lit("unknown_number:"), x.cast("string")))
    return F.concat(
        F.when(F.length(c) > max_chars, F.array(F.lit("too_long"))).otherwise(none),
        F.when(sentence_count(c) > max_sentences, F.array(F.lit("too_many_sentences"))).otherwise(none),
        F.transform(banned_terms(c), lambda t: F.concat(F.lit("banned:"), t)),
        F.when(has_link(c), F.array(F.lit("link"))).otherwise(none),
        unknown,
    )


def error_kinds(codes: Column) -> Column:
    """Codes without their details, each once, in order."""
    return F.array_distinct(F.transform(codes, lambda x: F.split_part(x, F.lit(":"), F.lit(1))))


def humanize(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "_", " ")


def citations(c: Column, allowed: list[str]) -> Column:
    """Names in [brackets] that are allowed, each once, in order of mention."""
    found = F.regexp_extract_all(c, F.lit(r"\[([A-Za-z0-9_.-]+)\]"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x.isin(allowed)))


def search_score(label: Column, keywords: Column, query: str) -> Column:
    """2 for each query term found in label or keywords and 2 if the label starts with the query; null unless all terms are found."""
    terms = query.lower().split()
    text = F.lower(F.concat_ws(" ", label, keywords))
    score = F.lit(2 * len(terms)) + F.when(F.lower(label).startswith(query.lower().strip()), 2).otherwise(0)
    hit = F.lit(bool(terms))
    for t in terms:
        hit = hit & text.contains(t)
    return F.when(hit, score)


def alert_sentence(names: Column, start: Column, end: Column, stretches: Column) -> Column:
    """What to say of a warning: one stretch by its street, several by their span to the nearest ten metres."""
    span = (F.floor((end - start) / 10 + 0.5) * 10).cast("long").cast("string")
    several = F.concat(stretches.cast("string"), F.lit(" stretches over the next "), span, F.lit(" meters: "), F.array_join(names, ", "))
    return F.when(stretches > 1, several).otherwise(F.concat(F.lit("Higher risk on "), F.coalesce(F.get(names, F.lit(0)), F.lit("a side street"))))


def parse_bbox(raw: str, most: float = 0.3) -> tuple[float, float, float, float]:
    """(west, south, east, north) from 'w,s,e,n'; a ValueError for anything that is no box of at most `most` degrees."""
    parts = [float(x) for x in raw.split(",")]
    if len(parts) != 4 or not all(abs(x) <= 180 for x in parts):
        raise ValueError("a box is four numbers")
    w, s, e, n = parts
    if not (w < e and s < n and e - w <= most and n - s <= most):
        raise ValueError("a box runs from west to east and south to north and is small")
    return w, s, e, n
