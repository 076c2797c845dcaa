"""Operators with state: each for streams, with a twin that gives the same over a finished table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridian.operators.ranking import previous, running, running_within

TTL_DAYS = 14
GAP_S = 3.0
WINDOW_S, MOST = 60.0, 10


def stream_hourly(events: DataFrame, key: str, late: str = "30 minutes") -> DataFrame:
    """(bucket, key, n, total) of a stream of ts, key and value; rows later than `late` after the newest are dropped."""
    hours = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), key)
    return hours.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), key, "n", "total")


def stream_distinct(events: DataFrame, keys: list[str], late: str = "30 minutes") -> DataFrame:
    """A stream without rows that repeat the keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upsert_reports(events: DataFrame, keys: list[str], ttl: Column) -> DataFrame:
    """The last report of each key: (keys, created_at, updated_at, expires_at, confirmations).

    An event confirms the report that has not expired by then and puts off its end to `ttl`
    after the event; else it makes a new one. Each outcome rests on the gap before it, which is found over ranges of
    (keys, time), so a key may hold any share of the events. Events without a time go.
    """
    order = [*map(F.col, keys), F.col("ts"), F.col("event_id")]
    e = previous(events.where("ts is not null").select(*keys, "ts", "event_id"), order, {k: f"__{k}" for k in keys} | {"ts": "__p"})
    same = F.col("__p").isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    new = ~same | (F.col("__p") + ttl <= F.col("ts"))
    runs = running(e.withColumn("__new", new.cast("long")), order, {"__run": F.col("__new")}, inclusive=True)
    reports = runs.groupBy(*keys, "__run").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("confirmations"))
    last = reports.groupBy(*keys).agg(F.max_by(F.struct("created_at", "updated_at", "confirmations"), "__run").alias("r"))
    return last.select(*keys, "r.*", (F.col("r.updated_at") + ttl).alias("expires_at"))


def active(reports: DataFrame, now: Column) -> DataFrame:
    return reports.where(F.col("expires_at") > now)


def stream_reports(events: DataFrame, keys: list[str], key_schema: str, ttl_ms: int) -> DataFrame:
    """upsert_reports over a stream: the report after each batch, with its state dropped when it expires.

    `events` has the keys and ts under a watermark; times in the result are epoch milliseconds.
    """
    out = f"{key_schema}, created_ms long, updated_ms long, expires_ms long, confirmations long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        created, updated, n = state.get if state.exists else (0, 0, 0)
        times = sorted(int(t.value // 1_000_000) for f in frames for t in f["ts"])
        for t in times:
            if not n or updated + ttl_ms <= t:
                created, n = t, 0
            updated, n = max(updated, t), n + 1
        state.update((created, updated, n))
        state.setTimeoutTimestamp(max(updated + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, created, updated, updated + ttl_ms, n)], columns=[*keys, "created_ms", "updated_ms", "expires_ms", "confirmations"])

    return events.groupBy(*keys).applyInPandasWithState(
        run, out, "created long, updated long, n long", "update", GroupStateTimeout.EventTimeTimeout
    )


def walked(events: DataFrame, key: str, seconds: float, columns: list[str], step: Callable[[object, tuple], tuple[object, tuple | None]], out: str) -> DataFrame:
    """Rows (of the columns `out`, DDL) that `step` makes of the events of each key, in order of time.

    `step` gets the state, None at first, and (event_id, t, *columns) of the next event, and gives the new
    state and a row or None. After a pause of more than `seconds` the state is None again. Runs of events
    without such a pause are found over ranges of (key, time), so that no task holds a key, and each
    is walked in order with the state as all there is, however long it is. Events of a null key go.
    """
    e = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "event_id", F.col("ts").cast("double").alias("__t"), *columns)
    order = [F.col(key), F.col("__t"), F.col("event_id")]
    e = previous(e, order, {key: "__k", "__t": "__p"})
    new = ~F.coalesce((F.col("__k") == F.col(key)) & (F.col("__t") - F.col("__p") <= seconds), F.lit(False))
    e = running(e.withColumn("__new", new.cast("long")), order, {"__run": F.col("__new")}, inclusive=True)
    names = [f.name for f in T.StructType.fromDDL(out)]

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = None, None
        for f in frames:
            rows = []
            for r, *values in zip(*[f.column(i).to_pylist() for i in range(f.num_columns)]):
                if r != run:
                    run, held = r, None
                held, row = step(held, tuple(values))
                if row is not None:
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t.type) for i, t in enumerate(arrow)], names=names)

    arrow = to_arrow_schema(T.StructType.fromDDL(out))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = e.select("__run", "event_id", "__t", *columns).repartition(n, "__run").sortWithinPartitions("__run", "__t", "event_id")
    return dealt.mapInArrow(walk, out)


def _accepted(events: DataFrame, key: str, seconds: float, accepts: Callable[[list[float], float], list[float] | None]) -> DataFrame:
    """(event_id) of the accepted events of each key: `accepts` gets the times of accepted events that still count and the next time, and gives the new list, or None to refuse."""

    def step(kept: list[float] | None, event: tuple) -> tuple[list[float], tuple | None]:
        got = accepts(kept or [], event[1])
        return (kept or [], None) if got is None else (got, (event[0],))

    return walked(events, key, seconds, [], step, "event_id long")


def throttle(events: DataFrame, key: str, seconds: float = GAP_S) -> DataFrame:
    """(event_id): events accepted if at least `seconds` have passed since the last accepted one of their key. Events of a null key go."""
    return _accepted(events, key, seconds, lambda kept, t: [t] if not kept or t - kept[0] >= seconds else None)


def sliding_limit(events: DataFrame, key: str, seconds: float = WINDOW_S, most: int = MOST) -> DataFrame:
    """(event_id): events accepted if fewer than `most` (1 or more) of their key were accepted at most `seconds` before. Events of a null key go."""

    def accepts(kept: list[float], t: float) -> list[float] | None:
        kept = [x for x in kept if t - x <= seconds]
        return [*kept, t] if len(kept) < most else None

    return _accepted(events, key, seconds, accepts)


def stream_throttle(events: DataFrame, key: str, key_type: str, seconds: float = GAP_S) -> DataFrame:
    """throttle over a stream (event_id, ts, key): accepted events as they come, one number of state per key.

    With a watermark on ts the state of a key goes once no event can be refused by it any more.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        g = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for t, i in zip(g["ts"], g["event_id"]):
            t = t.value / 1e9
            if t - last >= seconds:
                out.append(int(i))
                last = t
        state.update((last,))
        if watched:
            state.setTimeoutTimestamp(max(int((last + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "event_id": out})

    watched = "EventTimeWatermark" in events._jdf.queryExecution().analyzed().toString()
    timeout = GroupStateTimeout.EventTimeTimeout if watched else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, event_id long", "last double", "append", timeout)


def check_ins(trips: DataFrame, snoozes: DataFrame, now: Column, grace: Column | None = None) -> DataFrame:
    """`trips` (trip, start, eta_s, cancelled) with due_at and due: a check-in is due `grace` (10 minutes) after the planned end.

    Each snooze (trip) puts it off by as much again; a cancelled trip is never due.
    """
    minutes = F.expr("interval 10 minutes") if grace is None else grace
    times = snoozes.groupBy("trip").agg(F.count("*").alias("__n"))
    out = trips.join(times, "trip", "left")
    end = F.timestamp_micros(F.unix_micros("start") + (F.col("eta_s") * 1_000_000).cast("long"))
    due = end + minutes * (1 + F.coalesce("__n", F.lit(0)))
    return out.withColumns({"due_at": due, "due": ~F.coalesce("cancelled", F.lit(False)) & (due <= now)}).drop("__n")


def daily_cap(events: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` events of each key and day, numbered over ranges, so that a key may hold any share of a day."""
    of_day = events.withColumn("__k", F.struct(F.col(key).alias("k"), F.to_date("ts").alias("d")))
    return running_within(of_day, "__k", [F.col("ts"), F.col("event_id")], {}, "__r").where(F.col("__r") <= most).drop("__k", "__r")


def sessions(events: DataFrame, key: str, gap: str = "6 hours") -> DataFrame:
    """(key, start, end, n): sessions that end `gap` after their last event."""
    return events.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def as_of(asks: DataFrame, facts: DataFrame, on: list[str], value: str, max_age_s: int) -> DataFrame:
    """`asks` (on, ts) with the value of the latest fact (on, ts, value) at or before ts and not older than `max_age_s`.

    Time is cut into slices of the greatest age, and a fact is copied to its own slice and
    the next; what an ask needs lies in its slice. So a task holds a slice of a key, and the
    copies are two a fact. Of facts at one time the largest value counts.
    """
    cut = lambda c: F.floor(F.unix_timestamp(c) / max_age_s)
    f = facts.select(*on, F.col("ts").alias("__t"), F.col(value).alias("__v"), F.explode(F.array(cut("ts"), cut("ts") + 1)).alias("__s"))
    a = asks.withColumns({"__t": F.col("ts"), "__s": cut("ts"), "__ask": F.lit(1)})
    w = Window.partitionBy(*on, "__s").orderBy("__t", "__ask", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(f.withColumn("__ask", F.lit(0)), allowMissingColumns=True)
    fact = F.when(F.col("__ask") == 0, F.struct("__t", "__v"))
    got = both.withColumn("__last", F.last(fact, ignorenulls=True).over(w)).where("__ask = 1")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fresh = micros("ts") - micros("__last.__t") <= max_age_s * 1_000_000
    return got.withColumn(value, F.when(fresh, F.col("__last.__v"))).select(*asks.columns, value)
