"""The task state machine as a stream: every task's state lives in the state store, and timers cancel and delete tasks that nobody moves."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spandrel.functions.scalar import TERMINAL
from spandrel.operators.tasks import TRANSITIONS

IDLE_MS = 8 * 3600 * 1000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG_ROW = Row("task_id", "at_ms", "event_id", "kind", "event", "status")
LOG = "task_id long, at_ms long, event_id long, kind string, event string, status string"


class Machine(StatefulProcessor):
    """Moves tasks along TRANSITIONS; what it returns is the log of what happened to each. Every call of the store is a message to the JVM, so a task has
    one timer, whose time its state gives, and is asked for once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "status string, updated long")

    def close(self) -> None:
        pass

    @staticmethod
    def expired(state: tuple[str, int] | None, now: int) -> Iterator[tuple[str, int, tuple[str, int] | None]]:
        """What idleness does to a task up to ``now``: kind, time and the state left behind."""
        while state and state[1] + IDLE_MS <= now:
            at = state[1] + IDLE_MS
            state = None if state[0] in TERMINAL else ("CANCELLED", at)
            yield ("cancelled" if state else "deleted"), at, state

    def _state(self) -> tuple[str, int] | None:
        found = self.task.get()
        return None if found is None else tuple(found)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, log = self._state(), []
        state = before
        for r in sorted(rows, key=lambda r: (r.at_ms, r.event_id is None, r.event_id or 0)):
            for kind, at, state in self.expired(state, r.at_ms):
                log.append((key[0], at, None, kind, "idle", state[0] if state else None))
            to = TRANSITIONS.get((state[0] if state else "PENDING", r.event))
            if state and r.at_ms < state[1]:
                log.append((key[0], r.at_ms, r.event_id, "late", r.event, state[0]))
            elif to:
                state = (to, r.at_ms)
                log.append((key[0], r.at_ms, r.event_id, "moved", r.event, to))
            else:
                log.append((key[0], r.at_ms, r.event_id, "illegal", r.event, state[0] if state else None))
        self._keep(before, state)
        return (LOG_ROW(*x) for x in log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before, log = self._state(), []
        state = before
        for kind, at, state in self.expired(state, timerValues.getCurrentWatermarkInMs()):
            log.append((key[0], at, None, kind, "idle", state[0] if state else None))
        self._keep(before, state)
        return (LOG_ROW(*x) for x in log)

    def _keep(self, before: tuple[str, int] | None, state: tuple[str, int] | None) -> None:
        """The state and its timer after ``before``; what has not changed is not written again."""
        if state == before:
            return
        if state:
            self.task.update(state)
        else:
            self.task.clear()
        old, new = (s[1] + IDLE_MS if s else None for s in (before, state))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)


def moves(events: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The log (LOG) of a stream of ``events`` (task_id, event_id, at_ms, event, and a timestamp with the same time).

    A legal move changes the task; another one is logged as illegal, and one before the last move as late, and neither keeps a task alive. A task that nothing moves for eight hours is cancelled, one that has ended is deleted:
    by the next event, if that comes later than this, or by a timer as soon as the watermark passes it. So the log doesn't depend on how a stream that comes in order of time is cut into
    batches. The session's state store must be RocksDB (``STORE``).
    """
    return events.withWatermark(ts, delay).groupBy("task_id").transformWithState(Machine(), LOG, "append", "EventTime")
