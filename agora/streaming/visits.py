"""When to look at a source again: a plan of visits that follows how often the source changes.

A change of the source draws the expected gap between changes towards the gap just seen, and the next visit is due one gap
after the change, if that is sooner; a visit that finds no change since the last one doubles the wait. A visit counts the
changes up to its own time. Changes wait in state until the watermark has passed them and are then taken in the order of
their times, with the visits between them. So the plan depends on the times alone: the same events give the same visits,
however they are cut into batches and in whatever order they come within the delay.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import with_store

#: The visits of a source that a batch or a timer gives, as lists of equal length: a row for each source costs far less than one for each visit.
VISITS = T.StructType([T.StructField("source", T.StringType())] + [T.StructField(name, T.ArrayType(T.LongType())) for name in ("at_ms", "wait_ms", "changes")])
STATE = T.StructType([T.StructField(f"{name}_ms", T.LongType()) for name in ("last", "gap", "wait", "due", "timer")] + [T.StructField("changes", T.LongType()), T.StructField("waiting", T.LongType())])
#: Times that wait, as 64-bit numbers in bytes, so many in a value of the list at most.
PENDING, CHUNK = T.StructType([T.StructField("times", T.BinaryType())]), 65_536


class Plan(NamedTuple):
    last: int | None
    gap: int
    wait: int
    due: int | None
    changes: int


def advanced(plan: Plan, times: list[int], mark: int, least: int, most: int, learn: float) -> tuple[list[tuple[int, int, int]], Plan]:
    """The visits (at, wait, changes) before `mark` and the plan that follows, from the changes before it, in order; all in milliseconds."""
    last, gap, wait, due, changes = plan
    out = []
    for ms in [*times, mark]:
        while due is not None and due < ms:
            out.append((due, wait, changes))
            wait = gap if changes else min(2 * wait, most)
            due, changes = due + wait, 0
        if ms == mark:
            break
        if last is not None and ms > last:
            gap = int(min(max(gap + learn * (ms - last - gap), least), most))
        last, changes = ms, changes + 1
        if due is None:
            wait, due = gap, ms + gap
        elif ms + gap < due:
            wait, due = wait - (due - ms - gap), ms + gap
    return out, Plan(last, gap, wait, due, changes)


class Visits(StatefulProcessor):
    def __init__(self, least_ms: int, most_ms: int, learn: float):
        self.least_ms, self.most_ms, self.learn = least_ms, most_ms, learn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state, self.pending = handle, handle.getValueState("state", STATE), handle.getListState("pending", PENDING)

    def _advance(self, key, new: list[int], timerValues, fired: bool) -> Iterator[Row]:
        last, gap, wait, due, timer, changes, waiting = self.state.get() if self.state.exists() else (None, self.most_ms, self.most_ms, None, None, 0, 0)
        mark = timerValues.getCurrentWatermarkInMs()
        times = array("q")
        if waiting:
            for (chunk,) in self.pending.get():
                times.frombytes(chunk)
        times = sorted([*times, *new]) if new else times.tolist()  # what waits is in order
        cut = bisect_left(times, mark)
        out, plan = advanced(Plan(last, gap, wait, due, changes), times[:cut], mark, self.least_ms, self.most_ms, self.learn)
        left = times[cut:]
        if left and (new or cut):
            self.pending.put([(array("q", left[i : i + CHUNK]).tobytes(),) for i in range(0, len(left), CHUNK)])
        elif waiting and not left:
            self.pending.clear()
        if plan.due is None and not left:
            return  # a source that is late alone
        again = min(x for x in (plan.due, *left[:1]) if x is not None) + 1  # the watermark has passed what comes next
        if fired or again != timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(again)
        self.state.update((plan.last, plan.gap, plan.wait, plan.due, again, plan.changes, len(left)))
        if out:
            at, waited, seen = map(list, zip(*out, strict=True))
            yield Row(source=key[0], at_ms=at, wait_ms=waited, changes=seen)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()  # of the batches before
        return self._advance(key, [ms for _, ms in rows if ms >= mark], timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, [], timerValues, True)

    def close(self) -> None:
        pass


def visits(events: DataFrame, source: str, ts: str, delay: str = "1 hour", least_s: int = 600, most_s: int = 7 * 86400, learn: float = 0.3) -> DataFrame:
    """(source, visit_at, wait_s, changes) of a stream of events: when each source is due, how long was waited, and how many changes came since the visit before.

    Events that come later than `delay` behind the newest one of the batches before are left out; so are those without a time or a source. The state
    of a source is its plan and the times of its events within the delay; what a batch adds to it is bounded by the stream's own admission (`maxFilesPerTrigger`).
    """
    rows = with_store(events).select(F.col(source).cast("string").alias("source"), F.col(ts).cast("timestamp").alias("ts")).where("source is not null and ts is not null")
    timed = rows.withWatermark("ts", delay).select("source", F.unix_millis("ts").alias("ms"))  # every column of every event is made a Python value; late ones are left out there
    planned = timed.groupBy("source").transformWithState(Visits(least_s * 1000, most_s * 1000, learn), VISITS, "append", "eventTime")
    each = planned.select("source", F.inline(F.arrays_zip("at_ms", "wait_ms", "changes")))
    return each.select("source", F.timestamp_millis("at_ms").alias("visit_at"), F.expr("wait_ms div 1000").alias("wait_s"), "changes")
