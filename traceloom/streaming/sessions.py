"""Sessions on streams: runs of activity by session windows, and remote sessions by a stateful processor with timers."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.lateral import ACTIVE_WITHIN, ADMIN_WITHIN, CLOSE_WITHIN

OPENS, CLOSES = {1149, 21, 25, 4624, 4778}, {23, 24, 39, 40, 4634, 4647, 4779}


def stream_sessions(events: DataFrame, ts_col: str, source_col: str, threshold_minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(source, from_ts, to_ts, n) of each source's runs of minutes without a silence over the threshold, given when the
    watermark has passed them."""
    minutes = events.withColumn("minute", F.date_trunc("minute", ts_col)).withWatermark("minute", late)
    spans = minutes.groupBy(F.col(source_col).alias("source"), F.session_window("minute", f"{threshold_minutes * 60 + 1} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("minute").alias("to_ts"))
    return spans.select("source", F.col("w.start").alias("from_ts"), "to_ts", "n")


def status_of(ids: set[int], n: int) -> str:
    if ids & {23, 4634, 4647}:
        return "ENDED"
    if ids & {24, 39, 40, 4779}:
        return "DISCONNECTED"
    if 4625 in ids and not ids & {21, 22, 25, 4624, 4778}:
        return "FAILED"
    if ids & {21, 22, 25, 4778}:
        return "ACTIVE" if 22 in ids else "NO LOGOFF"
    return "INCOMPLETE" if n == 1 else "CONNECTING"


class RemoteSessions(StatefulProcessor):
    """The sessions of one (target, user), event by event in the order of time; see rdp_sessions() for the rules.

    Events wait until the watermark has passed them, so they are taken in order. They wait in parts, by hours of their time,
    and a key has one timer, that of its next event or of its session's end; so an event is written and read once or twice,
    and a task holds an hour of a key at a time. A session is given when the next one begins, or when nothing has come for
    `idle_seconds`; what the rules look back to stays.
    """

    STATE = "opened long, closed long, last_source string, last_ts long, current string, ids string, n long, first_ts long, source string, session_id string, admin boolean"
    HOUR = 3_600_000_000

    def __init__(self, idle_seconds: int = 86_400):
        self.idle = idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("parts", "hour long, part long", "events string")
        self.parts = handle.getValueState("parts_made", "n long")
        self.timer = handle.getValueState("timer", "at long")
        self.state = handle.getValueState("state", self.STATE)

    def _wait(self, events: list[tuple]) -> None:
        """Writes (ts, event_id, source, session_id) to their hours, each as a new part, and sees to it that the key wakes up."""
        hours, made = defaultdict(list), (self.parts.get() or (0,))[0]
        for e in events:
            hours[e[0] // self.HOUR].append(e)
        for hour, some in hours.items():
            self.waiting.updateValue((hour, made), (json.dumps(some),))
            made += 1
        self.parts.update((made,))
        self._wake(min(e[0] for e in events) // 1000)

    def _wake(self, at: int) -> None:
        known = self.timer.get()
        if known is None or at < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        none = lambda v: None if pd.isna(v) else v
        for pdf in rows:
            if len(pdf):
                self._wait([(int(r.at), int(r.event_id), none(r.source), none(r.session_id)) for r in pdf.itertuples(index=False)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # nothing up to it is still to come
        self.timer.clear()
        state = self.state.get()
        names = [c.split()[0] for c in self.STATE.split(", ")]
        s = dict(zip(names, state, strict=True)) if state is not None else dict.fromkeys(names) | {"n": 0, "ids": "", "admin": False}
        hours = defaultdict(list)
        for hour, part in list(self.waiting.keys()):
            hours[hour].append((hour, part))
        for hour in sorted(hours):
            if hour * self.HOUR // 1000 > now:
                self._wake(hour * self.HOUR // 1000)
                break
            events = [tuple(e) for part in hours[hour] for e in json.loads(self.waiting.getValue(part)[0])]
            later = [e for e in events if e[0] // 1000 > now]
            if len(later) < len(events):
                for part in hours[hour]:
                    self.waiting.removeKey(part)
                if later:
                    self._wait(later)
            elif later:
                self._wake(min(e[0] for e in later) // 1000)
            out: list[tuple] = []
            for event in sorted((e for e in events if e[0] // 1000 <= now), key=lambda e: (e[0], e[1], e[2] or "", e[3] or "")):
                self._take(s, event, key, out)
            if out:
                yield self._frame(out)
        if s["n"] and s["last_ts"] + self.idle <= now * 1000:
            yield self._frame([self._given(s, key)])
            s |= {"n": 0, "ids": "", "first_ts": None, "source": None, "session_id": None, "admin": False}
        elif s["n"]:
            self._wake((s["last_ts"] + self.idle) // 1000 + 1)
        self.state.update(tuple(s[c] for c in names))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["target", "user", "source", "session_id", "first_ts", "last_ts", "n", "status", "admin", "reconnect"])

    def _take(self, s: dict, event: tuple, key: tuple, out: list) -> None:
        ts, event_id, source, session_id = event
        apart = lambda c: (ts - s[c]) / 1e6
        opens, closes = event_id in OPENS, event_id in CLOSES
        fresh = opens and (s["opened"] is None or apart("opened") > ACTIVE_WITHIN or (s["closed"] is not None and s["closed"] >= s["opened"]) or (source is not None and s["last_source"] is not None and s["last_source"] != source))
        if fresh:
            s["current"] = None
        other = opens and None not in (session_id, s["current"]) and s["current"] != session_id
        linked = session_id is not None and s["current"] == session_id or source is not None and s["last_source"] == source
        alone = closes and not linked and (s["last_ts"] is None or apart("last_ts") > CLOSE_WITHIN)
        if (fresh or other or alone) and s["n"]:
            out.append(self._given(s, key))
            s |= {"n": 0, "ids": "", "first_ts": None, "source": None, "session_id": None, "admin": False}
        admin = event_id == 4672 and s["opened"] is not None and apart("opened") <= ADMIN_WITHIN
        s |= {"n": s["n"] + 1, "ids": ",".join(sorted({*filter(None, s["ids"].split(",")), str(event_id)})), "first_ts": s["first_ts"] or ts, "last_ts": ts, "source": s["source"] or source, "session_id": s["session_id"] or session_id, "admin": s["admin"] or admin}
        if opens:
            s |= {"opened": ts, "last_source": source or s["last_source"], "current": session_id or s["current"]}
        if closes:
            s["closed"] = ts

    def _given(self, s: dict, key: tuple) -> tuple:
        ids, at = {int(i) for i in s["ids"].split(",")}, lambda c: pd.Timestamp(s[c], unit="us", tz="UTC")
        return (*key, s["source"], s["session_id"], at("first_ts"), at("last_ts"), s["n"], status_of(ids, s["n"]), s["admin"], bool(ids & {25, 4778}))

    def close(self) -> None:
        pass


def stateful_store(spark: SparkSession) -> None:
    """Streams with a stateful processor need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_rdp_sessions(events: DataFrame, late: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """Remote sessions of a stream of (event_id, ts, source, target, user, session_id), each given once.

    Rows later than the watermark are dropped, as Spark counts (numRowsDroppedByWatermark of the query's progress).
    """
    known = lambda c: F.when(~F.coalesce(F.upper(F.trim(c)), F.lit("")).isin("", "-", "LOCAL"), F.col(c)).alias(c)
    rows = events.withWatermark("ts", late).select("target", "user", "ts", F.unix_micros("ts").alias("at"), "event_id", known("source"), known("session_id"))
    schema = "target string, user string, source string, session_id string, first_ts timestamp, last_ts timestamp, n long, status string, admin boolean, reconnect boolean"
    return rows.groupBy("target", "user").transformWithStateInPandas(RemoteSessions(idle_seconds), schema, "Append", "EventTime")
