"""Time functions. Timestamps are instants in a UTC session unless a zone is named."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONE = "America/New_York"

# Hours of the day parts, and the observer and sun elevations of the light classes.
DAY_PARTS = {"night": [22, 23, 0, 1, 2, 3, 4, 5], "morning": [6, 7, 8, 9, 10, 11], "afternoon": [12, 13, 14, 15, 16, 17], "evening": [18, 19, 20, 21]}
OBSERVER = (33.7756, -84.3963)
DAY_ABOVE, TWILIGHT_ABOVE = -0.833, -6.0


def utc_hour(ts: Column) -> Column:
    """The start of the hour, floored in UTC, so a repeated local hour stays two hours."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 3600) * 3600)


def local_to_instant(local: Column, zone: str = ZONE) -> Column:
    """A zone's wall-clock timestamp as an instant.

    An ambiguous time (clocks set back) is null; one that never was (clocks set forward)
    moves to the first instant after the gap.
    """
    t = F.to_utc_timestamp(local, zone)
    hour = F.expr("interval 1 hour")
    back = F.from_utc_timestamp(t, zone)
    twice = (F.from_utc_timestamp(t + hour, zone) == local) | ((F.from_utc_timestamp(t - hour, zone) == local) & (back == local))
    return F.when(twice, None).when(back != local, F.to_utc_timestamp(F.date_trunc("hour", back), zone)).otherwise(t)


def parse_local(text: Column, formats: list[str], zone: str = ZONE) -> Column:
    """The first format that fits, as wall-clock time of `zone`; null if none does."""
    return local_to_instant(F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats]), zone)


def from_epoch_ms(ms: Column, wall_clock: bool = False, zone: str = ZONE) -> Column:
    """Epoch milliseconds as an instant; with wall_clock they hold a zone's clock digits."""
    t = F.timestamp_millis(ms.cast("long"))
    return F.to_utc_timestamp(t, zone) if wall_clock else t


def day_group(ts: Column) -> Column:
    """weekday (Monday to Thursday), friday, saturday or sunday."""
    d = F.weekday(ts)
    return F.when(d <= 3, "weekday").when(d == 4, "friday").when(d == 5, "saturday").when(d == 6, "sunday")


def day_part(hour: Column) -> Column:
    out = None
    for name, hours in DAY_PARTS.items():
        out = F.when(hour.isin(hours), name) if out is None else out.when(hour.isin(hours), name)
    return out


def hour_bin(hour: Column) -> Column:
    """Fixed bins of hours: 0-5, 6-9, 10-14, 15-18, 19-23."""
    return F.when(hour <= 5, "0-5").when(hour <= 9, "6-9").when(hour <= 14, "10-14").when(hour <= 18, "15-18").when(hour <= 23, "19-23")


def sun_elevation(ts: Column, lat: float = OBSERVER[0], lon: float = OBSERVER[1]) -> Column:
    """Apparent elevation of the sun in degrees (low-precision almanac series with refraction)."""
    n = F.unix_timestamp(ts) / 86400.0 - 10957.5
    g = F.radians((F.lit(357.529) + F.lit(0.98560028) * n) % 360)
    q = F.lit(280.459) + F.lit(0.98564736) * n
    ecl = F.radians((q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g)) % 360)
    tilt = F.radians(F.lit(23.439) - F.lit(0.00000036) * n)
    right = F.atan2(F.cos(tilt) * F.sin(ecl), F.cos(ecl))
    declination = F.asin(F.sin(tilt) * F.sin(ecl))
    sidereal = F.radians((F.lit(280.46061837) + F.lit(360.98564736629) * n + lon) % 360)
    turn = sidereal - right
    up = F.asin(F.sin(F.radians(F.lit(lat))) * F.sin(declination) + F.cos(F.radians(F.lit(lat))) * F.cos(declination) * F.cos(turn))
    h = F.degrees(up)
    bend = F.when(h > -1.0, 1.02 / F.tan(F.radians(h + 10.3 / (h + 5.11))) / 60).otherwise(0.0)
    return h + bend


def light(ts: Column) -> Column:
    """day, twilight or dark at the observer."""
    h = sun_elevation(ts)
    return F.when(h > DAY_ABOVE, "day").when(h > TWILIGHT_ABOVE, "twilight").when(h.isNotNull(), "dark")


def hours_between(first: Column, last: Column) -> Column:
    """Hours of a range that may pass midnight: 22 to 6 gives 22, 23, 0 … 5; the end is not in it."""
    return F.transform(F.sequence(F.lit(0), F.pmod(last - first, F.lit(24)) - 1), lambda i: F.pmod(first + i, F.lit(24)))


def circular_mean_hour(hour: Column) -> Column:
    """Aggregate: mean hour on the clock face, 0 to 24."""
    turn = hour * F.lit(3.141592653589793) / 12
    return F.pmod(F.atan2(F.sum(F.sin(turn)), F.sum(F.cos(turn))) * 12 / F.lit(3.141592653589793), F.lit(24.0))


def decay(age_days: Column, half_life: float = 14.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def hour_similarity(a: Column, b: Column) -> Column:
    """1 up to an hour apart on the clock face, falling to 0 at three."""
    gap = F.abs(a - b)
    gap = F.least(gap, 24 - gap)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (3.0 - gap) / 2.0))


def day_similarity(a: Column, b: Column) -> Column:
    """1 for the same weekday (Monday 0), 0.6 within working days or within the weekend, else 0.2."""
    return F.when(a == b, 1.0).when((a >= 5) == (b >= 5), 0.6).otherwise(0.2)


def time_label(ts: Column, zone: str = ZONE) -> Column:
    """'10 PM' in a zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "h a")


def cell_at(ts: Column, wet: Column, zone: str = ZONE) -> Column:
    """The kind of hour of an instant: struct of day_group, hour, light and wet."""
    local = F.from_utc_timestamp(ts, zone)
    return F.struct(day_group(local).alias("day_group"), F.hour(local).alias("hour"), light(ts).alias("light"), wet.alias("wet"))


def reference_dates(today: Column) -> Column:
    """Map from day group to its first date from today on."""
    days = F.transform(F.sequence(F.lit(6), F.lit(0), F.lit(-1)), lambda i: F.date_add(today, i))
    return F.aggregate(days, F.expr("cast(map() as map<string,date>)"), lambda m, d: F.map_concat(F.map_filter(m, lambda k, _: k != day_group(d)), F.create_map(day_group(d), d)))


def arrival(start: Column, seconds: Column) -> Column:
    return start + F.make_dt_interval(secs=seconds)
