"""Reminders as state, and delivery once, over batches, restarts and late rows."""

import datetime
import random
import time
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from noticewright.streaming import reminders as R
from noticewright.streaming.incremental import ingest, stream_of

DAY0 = datetime.datetime(2024, 3, 1)


def brute(rows):
    """user, event_id, ts, item, deadline -> what is sent, row by row in order of time."""
    items, history, out = {}, {}, []
    for user, _, ts, item, deadline in sorted(rows, key=lambda r: (r[2], r[1])):
        if item is not None:
            if items.get((user, item), (None,))[0] != deadline:
                items[user, item] = (deadline, set())
            continue
        for (u, i), (d, sent) in sorted(items.items()):
            left = (d - ts.date()).days
            if u == user and left in (3, 1, 0) and left not in sent:
                sent.add(left)
                mine = [t for t in history.get(user, []) if t >= ts - datetime.timedelta(days=30)] + [ts]
                history[user] = mine[-100:]
                out.append((user, i, d, left, ts, len(history[user])))
    return sorted(out)


def log(rng, n, days, items):
    rows = []
    for k in range(n):
        ts = DAY0 + datetime.timedelta(seconds=rng.randrange(days * 86_400))
        edit = rng.random() < 0.4
        rows.append((rng.randrange(3), k, ts, rng.randrange(items) if edit else None, ts.date() + datetime.timedelta(days=rng.randrange(5)) if edit else None))
    return sorted(rows, key=lambda r: r[2])


def put(spark, rows, path):
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, item long, deadline date").coalesce(1).write.parquet(path)


def run(spark, stream, out, state):
    with R.rocks_state(spark):
        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()


def test_reminders_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = log(rng, 1500, 50, 30)
    rows += [(0, 5000, DAY0 + datetime.timedelta(days=80), 3, DAY0.date() + datetime.timedelta(days=81)), (0, 5001, DAY0 + datetime.timedelta(days=80, hours=1), None, None)]
    source = str(tmp_path / "log")
    late = [i for i in range(200, 1400, 50)]  # some rows come a batch later, within the lateness
    parts = [rows[:500], rows[500:1000], rows[1000:]]
    for i in late:
        k = 0 if i < 500 else 1 if i < 1000 else 2
        if k < 2 and rows[i] in parts[k] and parts[k + 1][0][2] - rows[i][2] < datetime.timedelta(hours=20):
            parts[k].remove(rows[i])
            parts[k + 1].append(rows[i])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(spark, parts[0], f"{source}/1.parquet")
    for k in (1, 2):
        run(spark, R.reminders(stream_of(spark, source, "*", 1)), out, state)
        put(spark, parts[k], f"{source}/{k + 1}.parquet")
    end = [(0, 9_000_000, DAY0 + datetime.timedelta(days=90), None, None)]
    put(spark, end, f"{source}/4.parquet")
    run(spark, R.reminders(stream_of(spark, source, "*", 1)), out, state)
    got = sorted((r.user_id, r.item, r.deadline, r.days_left, datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=r.at), r.n_history) for r in spark.read.parquet(out).collect())
    want = brute(rows)
    assert max(w[5] for w in want) == 100 and want[[w[4] for w in want].index(rows[-1][2])][5] == 1
    assert got == want


class Counted:
    """A state handle in memory that counts calls."""

    def __init__(self):
        self.calls, self.timers, self.lists, self.map = 0, set(), {}, {}

    def getListState(self, name, schema):
        outer, rows = self, self.lists.setdefault(name, [])

        class State:
            def appendValue(self, v):
                outer.calls += 1
                rows.append(v)

            def put(self, values):
                outer.calls += 1
                rows[:] = values

            def get(self):
                outer.calls += 1
                return iter(list(rows))

            def clear(self):
                outer.calls += 1
                rows.clear()

        return State()

    def getMapState(self, name, keys, values):
        outer = self

        class State:
            def iterator(self):
                outer.calls += 1
                return iter(list(outer.map.items()))

            def containsKey(self, k):
                outer.calls += 1
                return k in outer.map

            def getValue(self, k):
                outer.calls += 1
                return outer.map.get(k)

            def updateValue(self, k, v):
                outer.calls += 1
                outer.map[k] = v

        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def test_calls_to_the_state_grow_with_batches_not_rows():
    rng, handle, sends = random.Random(5), Counted(), R.Reminders()
    rows = [(0, *r[1:]) for r in log(rng, 3000, 40, 20)]
    handle_rows = [Row(at=int((r[2] - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000, event_id=r[1], item=r[3], deadline=r[4]) for r in rows]
    sends.init(handle)
    got, cut = [], [handle_rows[k : k + 750] for k in range(0, 3000, 750)]
    for k, batch in enumerate(cut):
        list(sends.handleInputRows((0,), iter(batch), None) or ())
        mark = (cut[k][-1].at if k < 3 else cut[3][-1].at + 10**9) // 1000
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        for t in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(t)
            got += list(sends.handleExpiredTimer((0,), values, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)))
    assert handle.calls < 4 * (12 + 20)  # some a batch, and the items that changed
    assert sorted((r.item, r.days_left, r.n_history) for r in got) == sorted((w[1], w[3], w[5]) for w in brute(rows))


def test_late_rows_come_once(spark, tmp_path):
    source, day = str(tmp_path / "log"), lambda n: DAY0 + datetime.timedelta(days=n)
    batches = [[(1, 1, day(10), None, None), (1, 2, day(9), None, None)], [(1, 3, day(8), None, None), (1, 2, day(9), None, None), (1, 4, day(1), None, None), (1, 5, day(12), None, None)], [(1, 3, day(8), None, None), (1, 5, day(12), None, None), (1, 6, day(11), None, None)]]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k, rows in enumerate(batches):
        put(spark, rows, f"{source}/{k}.parquet")
        run(spark, R.deliver_once(stream_of(spark, source, "*", 1), "event_id", "ts").select("event_id"), out, state)
    # 4 is later than the mark, the second 3 too; 2 and 5 come again and go.
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 5, 6]


def test_ingest_keeps_the_first_whatever_batch_brings_it(spark, tmp_path):
    source, ids = str(tmp_path / "docs"), [[(9, "a"), (7, None)], [(5, "b"), (3, "a")], [(4, "a"), (1, "b"), (2, None), (8, "c")]]
    for k, rows in enumerate(ids):
        spark.createDataFrame(rows, "doc_id long, url string").coalesce(1).write.parquet(f"{source}/{k}.parquet")
        time.sleep(0.01)
    got = ingest(stream_of(spark, source, "*", 1), "ingest-test", "url", ["doc_id"])
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 8]
