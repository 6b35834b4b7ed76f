"""Retries that come due: a keyed state with timers over the stream of what deliveries have become.

A delivery that is to be tried again waits for its time. The stream tells it when that time has come, unless something
else has become of the delivery before. The state of a delivery is the one retry that it waits for and the attempts that
were announced already, as a value and a map of Spark's keyed state; a timer on the event time brings it back when
nothing else does. What comes out depends on event times alone, not on how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.session import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Retries that came due: attempt counts those of the delivery before.
DUE = "delivery_id bigint, attempt int, due_nano bigint"
MILLI = 10**6


class Waiting(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", "attempt int, due_nano bigint")
        self.told = handle.getMapState("told", "attempt int", "due_nano bigint")

    def announced(self, key, attempt: int, due: int) -> Iterator[Row]:
        """A retry that came due, once for each attempt."""
        if not self.told.containsKey((attempt,)):
            self.told.updateValue((attempt,), (due,))
            yield Row(delivery_id=key[0], attempt=attempt, due_nano=due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # the state is asked and told once for all rows of a batch: each time is a call to the store
        waits = self.waits.get() if self.waits.exists() else None
        for r in sorted(rows, key=lambda r: (r.at_nano, r.attempt)):
            if waits and waits[1] <= r.at_nano:
                yield from self.announced(key, *waits)
            waits = (r.attempt, r.next_attempt_nano) if r.status == "retry" else None
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if waits:
            self.waits.update(waits)
            self.handle.registerTimer(-(-waits[1] // MILLI))
        else:
            self.waits.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waits = self.waits.get() if self.waits.exists() else None
        if waits and waits[1] <= expiredTimerInfo.getExpiryTimeInMs() * MILLI:
            self.waits.clear()
            yield from self.announced(key, *waits)

    def close(self) -> None:
        pass


def due(states: DataFrame) -> DataFrame:
    """A stream of DUE from a stream of states (delivery_id, status, attempt, next_attempt_nano, at: event time with a
    watermark, at_nano: the same in nanoseconds): a retry whose time has come before anything else became of the delivery. A
    time has come when the watermark, or a later row of the delivery, is at or past it."""
    ship(states.sparkSession)
    states.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return states.groupBy("delivery_id").transformWithState(Waiting(), DUE, "append", "eventTime")
