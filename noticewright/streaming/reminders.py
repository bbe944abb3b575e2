"""Reminders as keyed state (survey rows N6, N7, N8), and delivery once within a lookback.

A user's edits set deadlines of items; every other row of theirs is a check. A check three days, one
day or none before a deadline reminds, once for each of them until the deadline is edited. What was
sent stays in a history of 30 days and 100 rows. Rows wait in state until the watermark has passed
them, so what a stream sends doesn't depend on how its rows were dealt to batches.
"""

from __future__ import annotations

import contextlib
import datetime
import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.views import table
from ..registry import query
from ..sources.tables import scratch
from .incremental import run_to_end, stream_of

REMIND_DAYS = (3, 1, 0)
KEPT_DAYS, KEPT_ROWS = 30, 100
#: How late a row may come, and still be seen in its place.
LATENESS = "1 day"
#: Rows that wait together in one value of the state.
APPENDED = 10_000

_DAY = 86_400_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SENT = "user_id long, item long, deadline date, days_left int, at long, n_history int"


class Reminders(StatefulProcessor):
    """State of a user: rows that wait, deadlines with the days already reminded of, and the history.

    A call to the state store costs more than a row does. So a user has one timer, at the first row that
    waits, and what the watermark has passed is handled together: state is read before it and written after.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<long>, event_id array<long>, item array<long>, deadline array<date>")
        self.items = handle.getMapState("items", "item long", "deadline date, sent array<int>")
        self.history = handle.getListState("history", "at long, item long, days_left int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Rows wait for the watermark; a timer stands at the first one's time."""
        firsts = []
        for some in itertools.batched(((r.at, r.event_id, r.item, r.deadline) for r in rows), APPENDED):
            self.waiting.appendValue(in_columns(some))
            firsts.append(min(w[0] for w in some))
        if firsts:
            self.handle.registerTimer(min(firsts) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for some in self.waiting.get():
            for w in zip(*some, strict=True):
                (due if w[0] < now else later).append(w)
        history = [tuple(h) for h in self.history.get()]
        stored = list(history)
        if due:
            self.waiting.clear()
            for some in itertools.batched(later, APPENDED):
                self.waiting.appendValue(in_columns(some))
            if later:
                self.handle.registerTimer(min(w[0] for w in later) // 1000 + 1)
            items = {k[0]: (deadline, tuple(sent)) for k, (deadline, sent) in self.items.iterator()}
            before = dict(items)
            for user_item in self.handled(sorted(due, key=lambda w: w[:2]), items, history):
                yield Row(user_id=key[0], **user_item)
            for item, (deadline, sent) in items.items():
                if before.get(item) != (deadline, sent):
                    self.items.updateValue((item,), (deadline, list(sent)))
        # A user who isn't seen any more keeps no history either.
        left = kept(history, now)
        if left != stored:
            self.history.put(left) if left else self.history.clear()
        if left:
            self.handle.registerTimer(left[-1][0] // 1000 + 2 + KEPT_DAYS * _DAY // 1000)

    def close(self) -> None:
        pass

    def handled(self, rows: list[tuple], items: dict[int, tuple], history: list[tuple]) -> Iterator[dict]:
        """What is sent for ``rows`` in their order; ``items`` and ``history`` are brought up to date. Items are
        looked up by their deadlines, so a check costs what it finds."""
        by_day: dict[datetime.date, set[int]] = {}
        for item, (deadline, _) in items.items():
            by_day.setdefault(deadline, set()).add(item)
        for at, _, item, deadline in rows:
            if item is not None:
                # Another deadline clears what was reminded of; the same one doesn't.
                if item not in items or items[item][0] != deadline:
                    if item in items:
                        by_day[items[item][0]].discard(item)
                    items[item] = (deadline, ())
                    by_day.setdefault(deadline, set()).add(item)
                continue
            today = datetime.date(1970, 1, 1) + datetime.timedelta(days=at // _DAY)
            near = sorted((i, left) for left in REMIND_DAYS for i in by_day.get(today + datetime.timedelta(days=left), ()))
            for i, left in near:
                deadline, sent = items[i]
                if left not in sent:
                    items[i] = (deadline, (*sent, left))
                    # The oldest go beyond their age or size.
                    history[:] = [*kept(history, at), (at, i, left)][-KEPT_ROWS:]
                    yield dict(item=i, deadline=deadline, days_left=left, at=at, n_history=len(history))


def in_columns(rows: tuple[tuple, ...]) -> tuple[list, ...]:
    """Rows as one value of the state."""
    return tuple(map(list, zip(*rows, strict=True)))


def kept(history: list[tuple], at: int) -> list[tuple]:
    """Rows of a history that are young enough at a time."""
    return [h for h in history if h[0] >= at - KEPT_DAYS * _DAY]


@contextlib.contextmanager
def rocks_state(spark: SparkSession):
    """State of any size on the executors' disks, with changes in the checkpoint."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def reminders(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """What is sent for a stream of ``rows`` (user_id, event_id, ts, item, deadline): with an item an edit,
    without one a check. Rows of one time go by event_id. Columns as ``SENT``, ``at`` in microseconds."""
    seen = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", lateness)
    return seen.groupBy("user_id").transformWithState(Reminders(), outputStructType=SENT, outputMode="Append", timeMode="EventTime")


def edits_and_checks(events: DataFrame) -> DataFrame:
    """The event log as edits and checks: purchases and signups set the deadline of one of five items
    to so many days ahead as their value says, by the week; all else is a check."""
    edit = F.col("event_type").isin("purchase", "signup")
    item = F.floor(F.get_json_object("props", "$.k").cast("long") / 20).cast("long")
    ahead = F.date_add(F.col("ts").cast("date"), F.pmod(F.floor("value"), F.lit(7)).cast("int"))
    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(edit, item).alias("item"), F.when(edit, ahead).alias("deadline"))


REMINDERS_SQL = """
WITH e AS (
  SELECT user_id, event_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) // 20 END AS item,
         CAST(ts AS DATE) + CAST(floor(value) AS INTEGER) % 7 AS deadline FROM events
), edits AS (
  SELECT *, CASE WHEN deadline IS DISTINCT FROM lag(deadline) OVER (PARTITION BY user_id, item ORDER BY ts, event_id) THEN 1 ELSE 0 END AS changed FROM e WHERE item IS NOT NULL
), runs AS (
  SELECT *, lead(ts) OVER w AS until_ts, lead(event_id) OVER w AS until_id FROM edits WHERE changed = 1 WINDOW w AS (PARTITION BY user_id, item ORDER BY ts, event_id)
), due AS (
  SELECT r.user_id, r.item, r.deadline, r.event_id AS run, c.ts, c.event_id, date_diff('day', CAST(c.ts AS DATE), r.deadline) AS days_left
  FROM runs r JOIN e c ON c.user_id = r.user_id AND c.item IS NULL AND (c.ts, c.event_id) > (r.ts, r.event_id) AND (r.until_ts IS NULL OR (c.ts, c.event_id) < (r.until_ts, r.until_id))
  WHERE date_diff('day', CAST(c.ts AS DATE), r.deadline) IN (3, 1, 0)
), sent AS (
  SELECT user_id, item, deadline, days_left, min(ts) AS ts FROM due GROUP BY user_id, item, deadline, run, days_left
)
SELECT user_id, item, deadline, CAST(days_left AS INTEGER) AS days_left, epoch_us(ts) AS at,
       CAST(least(100, count(*) OVER (PARTITION BY user_id ORDER BY ts, item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS INTEGER) AS n_history
FROM sent WHERE ts < TIMESTAMP '2024-01-28'
"""


@query("N07_reminder_state", REMINDERS_SQL)
def reminder_state(spark, d):
    """All reminders of the log before its last days, which the watermark hasn't passed (N6 to N8). The log spans
    less than the history keeps, so its length is the number sent so far."""
    with rocks_state(spark):
        sent = run_to_end(reminders(edits_and_checks(stream_of(spark, d, "events"))), "reminder-state")
    return sent.where(F.col("at") < F.unix_micros(F.lit("2024-01-28").cast("timestamp")))


def deliver_once(df: DataFrame, key: str, time: str, lookback: str = "3 days") -> DataFrame:
    """Rows of a stream, each ``key`` once within ``lookback``: the mark is the latest ``time`` less that much. What
    comes later still than the mark is dropped; state holds no key longer, so a batch costs what
    it brings, whatever came before."""
    return df.withWatermark(time, lookback).dropDuplicatesWithinWatermark([key])


@query("N02_lookback_once", "SELECT event_id, event_type FROM events")
def lookback_once(spark, d):
    """The log delivered twice, in two streams: every row once."""
    log = lambda: stream_of(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return run_to_end(deliver_once(log().union(log()), "event_id", "ts").select("event_id", "event_type"), "lookback")
