"""Leases that return while a stream runs.

Every link has a state of its own: its last transition, and while it is leased a
timer. A lease that is not finished in time goes back to the waiting links by a
transition that comes right after it in the log. State and timers lie in the state
store, so a stream that was killed goes on with them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperweave.schema import IN_PROGRESS, INITIAL, SEQ_TYPE, TRANSITION_SCHEMA

# executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Time column of a stream of transitions.
TIME = "at"


class LeaseTimers(StatefulProcessor):
    """Per link: keep its last transition, return its lease when the timer expires."""

    def __init__(self, timeout_ms: int, by_event_time: bool) -> None:
        self.timeout_ms, self.by_event_time = timeout_ms, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([
            T.StructField("source", T.StringType()), T.StructField("state", T.IntegerType()),
            *SEQ_TYPE.fields]))

    @staticmethod
    def _place(row: Row) -> tuple[int, ...]:
        return tuple(row["seq"][name] for name in SEQ_TYPE.names)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # the order of the log counts, not that of arrival
        newest = max(rows, key=self._place)
        if self.last.exists() and tuple(self.last.get())[2:] >= self._place(newest):
            return iter([])
        self.last.update((newest["source"], newest["state"], *self._place(newest)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if newest["state"] == IN_PROGRESS:
            leased = int(newest[TIME].timestamp() * 1000) if self.by_event_time else \
                timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(leased + self.timeout_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        source, state, *place = self.last.get()
        if state != IN_PROGRESS:
            return
        after = (*place[:-1], place[-1] + 1)
        self.last.update((source, INITIAL, *after))
        yield Row(url=key[0], source=source, state=INITIAL, seq=Row(*SEQ_TYPE.names)(*after))

    def close(self) -> None:
        pass


def returned_leases(transitions: DataFrame, timeout_ms: int, by_event_time: bool = False) -> DataFrame:
    """Stream of the transitions that give back leases not finished within the time.

    ``transitions`` is a stream with the columns of the log, and with ``at`` where
    time is that of the transitions; else it is the time of the cluster, and leases
    return while nothing arrives, too. To be appended to the log.
    """
    if by_event_time:
        transitions = transitions.withWatermark(TIME, "0 seconds")
    return transitions.groupBy("url").transformWithState(
        statefulProcessor=LeaseTimers(timeout_ms, by_event_time), outputStructType=TRANSITION_SCHEMA,
        outputMode="append", timeMode="EventTime" if by_event_time else "ProcessingTime")
