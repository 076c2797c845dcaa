"""Live sessions and spoken alerts: rules that depend on the order of events, over tables and over streams.

The rules are plain functions of a state and the next event. Over a table `state.walked` feeds them;
over a stream a processor keeps the state, holds events back until the watermark has passed them, and then takes them
in order of time. So a stream gives the same as a table, in whatever order events come within the tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

from meridian.streaming.state import walked

# Seconds between updates, of a session's life, and between alerts; metres ahead of an alert.
UPDATE_GAP_S, SESSION_S = 3.0, 6 * 3600.0
ALERT_GAP_S, LEAD_M = 45.0, 60.0
OPEN, ENDED = "walking", "ended"

#: What can become of an event of a session.
OUTCOMES = ["opened", "taken", "throttled", "ended", "outside", "missing"]


def update_session(held: tuple | None, event: tuple, gap: float, life: float) -> tuple[tuple | None, tuple]:
    """One event of a session: the new state (status, time of the last position or None, end of life) and (event_id, outcome, status, expires).

    An event is (event_id, t, opens, status, outside). One that opens starts a session if there is none alive, and is an
    update like any other if there is. Without a live session an update is missing. An ended session
    stays ended. A position outside is refused. An update within `gap` of the last position is throttled, unless it changes the status. One that is
    taken puts off the end of life to `life` after it.
    """
    i, t, opens, status, outside = event
    if held is not None and held[2] <= t:
        held = None
    if held is None:
        if not opens:
            return None, (i, "missing", None, None)
        held = (OPEN, None, t + life)
        return held, (i, "opened", *held[::2])
    now, last, end = held
    if now == ENDED:
        return held, (i, "ended", now, end)
    if outside:
        return held, (i, "outside", now, end)
    if (status is None or status == now) and last is not None and t - last < gap:
        return held, (i, "throttled", now, end)
    held = (status or now, t, t + life)
    return held, (i, "taken", *held[::2])


_SESSION = "event_id long, outcome string, status string, expires double"


def session_updates(events: DataFrame, key: str, gap: float = UPDATE_GAP_S, life: float = SESSION_S) -> DataFrame:
    """(event_id, outcome, status, expires) of each event of a session: what became of it, and the session after it.

    `events` has event_id, ts, the key, opens, status (null for a position alone) and outside (null is false). expires is in seconds since 1970. Events at one
    time are taken by event_id; those without a key or a time go. See `update_session`.
    """
    # a session lives until `life` after its last update, so a longer pause leaves none
    return walked(events, key, life, ["opens", "status", "outside"], partial(update_session, gap=gap, life=life), _SESSION)


def due_alert(held: tuple | None, at: tuple, gap: float, life: float) -> tuple[tuple, tuple | None]:
    """One alert that a position is in reach of: the new state (time of the last spoken or None, of the last seen, those spoken) and (event_id, alert) if it is spoken.

    `at` is (event_id, t, alert), of one position the first alert first. An alert is spoken once, `gap` seconds or more after the last. After
    more than `life` without an alert in reach a walk is another one.
    """
    i, t, alert = at
    if held is not None and t - held[1] > life:
        held = None
    last, _, spoken = held or (None, t, frozenset())
    if alert in spoken or last is not None and t - last < gap:
        return (last, t, spoken), None
    return (t, t, spoken | {alert}), (i, alert)


def _in_reach(positions: DataFrame, alerts: DataFrame, path: str, lead: float) -> DataFrame:
    """Positions (path, along) with each alert (path, alert, start, end) that starts within `lead` ahead and has not ended."""
    reach = alerts.select(path, "alert", "start", F.col("end").alias("__end"))
    return positions.join(reach, path).where((F.col("along") >= F.col("start") - lead) & (F.col("along") < F.col("__end"))).drop("start", "__end")


def _first_in_reach(positions: DataFrame, alerts: DataFrame, key: str, path: str, gap: float, lead: float) -> DataFrame:
    """Positions (event_id, ts, key) in reach of an alert, with alerts: those of them, in order, that can matter.

    A walk speaks once in `gap` seconds, so by a time it has spoken no more alerts than gaps have passed since the first position of its
    key; one more than that is all a position needs of what it is in reach of. Stretches of a path as long as an eighth of `lead` have
    a list each: of the alerts in reach of all their positions the first that any of these needs, and all that are in reach of some.
    So a position meets a list and not every alert of its path. Positions without a finite place are in reach of nothing.
    """
    width = max(lead, 1.0) / 8
    cell = lambda c: F.floor(c / width)
    since = positions.groupBy(key).agg(F.min(F.col("ts").cast("double")).alias("__since"))
    # one more than needed, as a quotient may be a little too small
    needed = (F.floor((F.col("ts").cast("double") - F.col("__since")) / gap) + 2).cast("int")
    p = positions.where(F.abs("along") < float("inf")).join(since, key).select("event_id", "ts", key, path, "along", needed.alias("__needed"), cell(F.col("along")).alias("__cell"))
    held = p.groupBy(path, "__cell").agg(F.min("along").alias("__low"), F.max("along").alias("__high"), F.max("__needed").alias("__most"))
    ends = held.groupBy(path).agg(F.min("__cell").alias("__a"), F.max("__cell").alias("__b"))
    span = alerts.join(ends, path).select(path, "alert", "start", "end", F.greatest("__a", cell(F.col("start") - lead)).alias("__a"), F.least("__b", cell(F.col("end"))).alias("__b"))
    spread = span.where("__a <= __b").select(path, "alert", "start", "end", F.explode(F.sequence("__a", "__b")).alias("__cell"))
    met = held.join(spread.hint("merge"), [path, "__cell"]).where((F.col("__high") >= F.col("start") - lead) & (F.col("__low") < F.col("end")))
    whole = (F.col("__low") >= F.col("start") - lead) & (F.col("__high") < F.col("end"))
    place = F.dense_rank().over(Window.partitionBy(path, "__cell", "__whole").orderBy("alert"))  # the alerts around one stretch
    kept = met.withColumn("__whole", whole).withColumn("__place", place).where("not __whole or __place <= __most")
    lists = kept.groupBy(path, "__cell").agg(F.array_sort(F.collect_list(F.struct("alert", "start", "end"))).alias("__l"))
    reached = F.filter("__l", lambda x: (F.col("along") >= x["start"] - lead) & (F.col("along") < x["end"]))
    first = F.slice(F.array_distinct(F.transform(reached, lambda x: x["alert"])), F.lit(1), F.col("__needed"))
    return p.join(lists, [path, "__cell"]).select("event_id", "ts", key, first.alias("alerts")).where(F.size("alerts") > 0)


def due_alerts(positions: DataFrame, alerts: DataFrame, key: str, path: str = "path", gap: float = ALERT_GAP_S, lead: float = LEAD_M, life: float = SESSION_S) -> DataFrame:
    """(event_id, alert): the alerts that are spoken along each walk, and the position at which each is.

    `positions` has event_id, ts, the key of its walk, path and along (metres); `alerts` has path, alert (numbered along the path), start
    and end. A position speaks the first alert in reach that its walk has not spoken, at least `gap` seconds after the last.
    Only positions in reach of an alert are walked, with the spoken alerts of one walk as the state, and bring no more alerts than their walk
    can have spoken before, and one. Positions at one time are taken by event_id; those without a key or a time go.
    """
    positions = positions.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select("event_id", "ts", key, path, "along")
    if gap > 0:
        rows = _first_in_reach(positions, alerts, key, path, gap, lead)
    else:
        near = _in_reach(positions, alerts, path, lead)
        rows = near.groupBy("event_id", "ts", key).agg(F.array_sort(F.collect_set("alert")).alias("alerts"))

    def step(held: tuple | None, event: tuple) -> tuple[tuple, tuple | None]:
        i, t, alerts = event
        for alert in alerts:
            held, spoken = due_alert(held, (i, t, alert), gap, life)
            if spoken:
                return held, spoken
        return held, None

    return walked(rows, key, life, ["alerts"], step, "event_id long, alert long")


class _Ordered(StatefulProcessor):
    """Feeds `step` the events of a key in order of time, once the watermark has passed them.

    State: the events held back, and what `step` keeps, as columns of `kept` (DDL).
    """

    def __init__(self, event: str, kept: str, out: list[str], life_ms: int | None):
        self.event, self.kept, self.out, self.life_ms = event, kept, out, life_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.event)
        self.held = handle.getValueState("held", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            for e in f.drop(columns=[f.columns[0], "ts"]).astype(object).itertuples(index=False, name=None):
                e = tuple(None if x is None or x != x else x for x in e)
                self.waiting.appendValue(e)
                self.handle.registerTimer(int(e[1] * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda e: (e[1], e[0], e[2] or 0)) if self.waiting.exists() else []
        due = [tuple(e) for e in waiting if e[1] * 1000 < upto]
        if due:
            left = [tuple(e) for e in waiting[len(due) :]]
            self.waiting.put(left) if left else self.waiting.clear()
            held, out = self.load(), []
            for e in due:
                held, row = self.step(held, e)
                if row is not None:
                    out.append((key[0], *row))
            self.save(held)
            if self.life_ms is not None:
                self.handle.registerTimer(int(due[-1][1] * 1000) + self.life_ms + 1)
            yield pd.DataFrame(out, columns=self.out)
        elif self.life_ms is not None and not waiting and self.done(upto):
            self.held.clear()

    def close(self) -> None:
        pass


class _Sessions(_Ordered):
    def __init__(self, key: str, gap: float, life: float):
        super().__init__("event_id long, t double, opens boolean, status string, outside boolean", "status string, last double, expires double", [key, "event_id", "outcome", "status", "expires"], int(life * 1000))
        self.gap, self.life = gap, life

    def load(self) -> tuple | None:
        return tuple(self.held.get()) if self.held.exists() else None

    def save(self, held: tuple | None) -> None:
        self.held.update(held) if held is not None else self.held.clear()

    def done(self, upto: int) -> bool:
        return self.held.exists() and self.held.get()[2] * 1000 <= upto

    def step(self, held: tuple | None, event: tuple) -> tuple[tuple | None, tuple]:
        return update_session(held, event, self.gap, self.life)


class _Alerts(_Ordered):
    def __init__(self, key: str, gap: float, life: float):
        super().__init__("event_id long, t double, alert long", "last double, seen double, spoken array<long>", [key, "event_id", "alert"], int(life * 1000))
        self.gap, self.life = gap, life

    def load(self) -> tuple | None:
        if not self.held.exists():
            return None
        last, seen, spoken = self.held.get()
        return last, seen, frozenset(spoken)

    def save(self, held: tuple) -> None:
        self.held.update((*held[:2], sorted(held[2])))

    def done(self, upto: int) -> bool:
        return self.held.exists() and (self.held.get()[1] + self.life) * 1000 < upto

    def step(self, held: tuple | None, event: tuple) -> tuple[tuple, tuple | None]:
        return due_alert(held, event, self.gap, self.life)


def stream_session_updates(events: DataFrame, key: str, key_type: str, gap: float = UPDATE_GAP_S, life: float = SESSION_S) -> DataFrame:
    """`session_updates` over a stream under a watermark on ts: (key, event_id, outcome, status, expires), once the watermark has passed an event.

    A session's state goes when the watermark has passed the end of its life.
    """
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "ts", "event_id", F.col("ts").cast("double").alias("t"), "opens", "status", "outside")
    return rows.groupBy(key).transformWithStateInPandas(_Sessions(key, gap, life), f"{key} {key_type}, {_SESSION}", "append", "eventTime")


def stream_due_alerts(positions: DataFrame, alerts: DataFrame, key: str, key_type: str, path: str = "path", gap: float = ALERT_GAP_S, lead: float = LEAD_M, life: float = SESSION_S) -> DataFrame:
    """`due_alerts` over a stream of positions under a watermark on ts, with a table of alerts: (key, event_id, alert), once the watermark has passed a position."""
    near = _in_reach(positions.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select("event_id", "ts", key, path, "along"), alerts, path, lead)
    rows = near.select(key, "ts", "event_id", F.col("ts").cast("double").alias("t"), "alert")
    return rows.groupBy(key).transformWithStateInPandas(_Alerts(key, gap, life), f"{key} {key_type}, event_id long, alert long", "append", "eventTime")
