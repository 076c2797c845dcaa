"""How each kind of crash feed is read into the canonical columns. Importing registers the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meridian.functions import text, times
from meridian.operators.ingest import column, rule

# Column names and time formats of the feeds.
CRASH_LEVEL = {
    "severity": "KABCO_Severity", "light_report": "Light_Conditions__Crash_Level_", "surface_report": "Surface_Condition__Crash_Level_",
    "road": "Roadway__From_Crash_Report_", "cross_road": "Intersection_Name__from_Crash_R",
}
DETAIL = {"severity": "KABCO_Severity", "light_report": "Light_Conditions", "surface_report": "Surface_Conditions", "road": "Roadway", "cross_road": "Intersecting_Roadway"}
YEARLY = {"severity": "KABCO_Severity", "road": "Roadway__From_Crash_Report_", "cross_road": "Intersecting_Roadway"}
LOCAL = ["MM/dd/yyyy hh:mm a"]
DATE_TIME = ["yyyy-MM-dd h:mm:ss a", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy HH:mm"]


def _base(raw: DataFrame, names: dict[str, str]) -> dict[str, Column]:
    out = {k: column(raw, v) for k, v in names.items()}
    out["severity"] = text.severity_letter(out["severity"])
    return out | {"source_id": column(raw, "OBJECTID"), "collision_id": column(raw, "Collision_ID"), "lat": column(raw, "lat"), "lon": column(raw, "lon")}


def _date_and_time(raw: DataFrame) -> Column:
    return times.parse_local(F.concat_ws(" ", F.trim(column(raw, "Date")), F.trim(column(raw, "Time"))), DATE_TIME)


def _people(raw: DataFrame) -> Column:
    return F.coalesce(column(raw, "F__of_Pedestrians_per_crash").try_cast("double"), F.lit(0.0)) > 0


@rule("yearly")
def yearly(raw: DataFrame) -> dict[str, Column]:
    """Only the year is known; a count of people on foot and a flag for bicycles."""
    return _base(raw, YEARLY) | {"year": column(raw, "Crash_Year").try_cast("int"), "is_ped": _people(raw), "is_bike": text.truthy(column(raw, "Bicycle_Related__T_F_"))}


@rule("ped_bike")
def ped_bike(raw: DataFrame) -> dict[str, Column]:
    """Modes in a text; the epoch holds clock digits."""
    mode = column(raw, "Mode")
    wall = F.timestamp_millis(column(raw, "Date_and_Time").try_cast("long"))
    return _base(raw, CRASH_LEVEL) | {"ts": times.local_to_instant(wall), "is_ped": text.contains(mode, "Ped"), "is_bike": text.contains(mode, "Bicycl")}


@rule("all_modes")
def all_modes(raw: DataFrame) -> dict[str, Column]:
    """No flags; those come back when rows are merged with other feeds."""
    return _base(raw, CRASH_LEVEL) | {"ts": times.parse_local(column(raw, "Date_and_Time"), LOCAL)}


@rule("downtown")
def downtown(raw: DataFrame) -> dict[str, Column]:
    return _base(raw, CRASH_LEVEL) | {"ts": times.parse_local(column(raw, "Date_and_Time"), LOCAL), "is_ped": text.contains(column(raw, "SHSP_Emphasis_Areas"), "edestrian")}


@rule("midtown")
def midtown(raw: DataFrame) -> dict[str, Column]:
    return _base(raw, DETAIL) | {
        "ts": times.parse_local(column(raw, "Date_and_Time"), LOCAL), "is_ped": text.truthy(column(raw, "Pedestrian_Related")), "is_bike": text.truthy(column(raw, "Bicycle_Related")),
    }


@rule("severe")
def severe(raw: DataFrame) -> dict[str, Column]:
    """A flag or a travel mode; riders of scooters are not cyclists. The epoch is an instant."""
    travel = column(raw, "TravelMode")
    return _base(raw, DETAIL) | {
        "ts": times.from_epoch_ms(column(raw, "Date_W_Time").try_cast("long")),
        "is_ped": text.truthy(column(raw, "Pedestrian_Related")) | text.contains(travel, "Ped"),
        "is_bike": text.truthy(column(raw, "Bicycle_Related")) | text.contains(travel, "Bicycl"),
    }


@rule("campus")
def campus(raw: DataFrame) -> dict[str, Column]:
    """Either of two harmful events may name the people."""
    events = [column(raw, "Most_Harmful_Event__Crash_Level_"), column(raw, "First_Harmful_Event__Unit_Order_")]
    either = lambda part: text.contains(events[0], part) | text.contains(events[1], part)
    names = CRASH_LEVEL | {"cross_road": "Intersection_Name__from_Crash_Report_"}
    return _base(raw, names) | {"ts": _date_and_time(raw), "is_ped": either("Pedestrian"), "is_bike": either("Pedal")}


@rule("county")
def county(raw: DataFrame) -> dict[str, Column]:
    mode = column(raw, "Crash_Mode")
    return _base(raw, CRASH_LEVEL | {"cross_road": "Intersecting_Roadway"}) | {
        "ts": _date_and_time(raw), "is_ped": F.coalesce(mode == "Pedestrian", F.lit(False)) | _people(raw), "is_bike": F.coalesce(mode == "Bicycle", F.lit(False)),
    }
