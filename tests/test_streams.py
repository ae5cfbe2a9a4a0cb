"""The task state machine and the ledger of failed batches over streams that are cut, stopped and run again."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spandrel.plans.stream_queries import with_rocks
from spandrel.streaming import machine, streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
HOUR = 3600 * 1000
SCHEMA = "task_id long, event_id long, at_ms long, event string, ts timestamp"


def moves_of(seed, n, tasks=6):
    rng, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice((1, HOUR // 4, HOUR, 3 * HOUR))
        out.append((rng.randrange(tasks), i, rng.choice(["start", "pause", "resume", "complete", "fail", "retry", "cancel", "nonsense", None])))
        out[-1] = (*out[-1][:2], int(START.timestamp() * 1000) + at, out[-1][2])
    return out


def write(spark, folder, rows, no):
    """One file; later numbers are read later."""
    data = [(t, i, at, e, datetime.fromtimestamp(at / 1000, timezone.utc)) for t, i, at, e in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{no}")
    for f in os.listdir(f"{folder}/{no}"):
        os.utime(f"{folder}/{no}/{f}", (1_700_000_000 + no, 1_700_000_000 + no))


def fold(rows):
    """The same by its definition: events in order, idleness looked at before each and at the end."""
    end = max(at for _, _, at, _ in rows) - 600_000
    state, log = {}, []

    def idle(task, now):
        while task in state and state[task][1] + 8 * HOUR <= now:
            status, since = state[task]
            if status in ("CANCELLED", "COMPLETED", "FAILED"):
                del state[task]
                log.append((task, since + 8 * HOUR, None, "deleted", "idle", None))
            else:
                state[task] = ("CANCELLED", since + 8 * HOUR)
                log.append((task, since + 8 * HOUR, None, "cancelled", "idle", "CANCELLED"))

    for task, i, at, event in rows:
        idle(task, at)
        to = machine.TRANSITIONS.get((state.get(task, ("PENDING",))[0], event))
        if to:
            state[task] = (to, at)
        log.append((task, at, i, "moved" if to else "illegal", event, state[task][0] if task in state else None))
    for task in list(state):
        idle(task, end)
    return sorted(log, key=str)


def run(spark, folder, out=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return sorted((tuple(r) for r in with_rocks(spark, lambda: streams.drain(machine.moves(stream), folder=out)).collect()), key=str)


@pytest.mark.parametrize("cuts", [[], [40, 41, 90]])
def test_log_is_the_same_however_the_stream_is_cut(spark, tmp_path, cuts):
    rows = moves_of(1, 120)
    for no, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        write(spark, tmp_path, rows[a:b], no)
    want = fold(rows)
    assert run(spark, str(tmp_path)) == want
    assert {"moved", "illegal", "cancelled", "deleted"} == {r[3] for r in want}


def test_goes_on_from_its_checkpoint_and_logs_late_moves(spark, tmp_path):
    rows = moves_of(2, 60)
    write(spark, tmp_path / "in", rows[:30], 0)
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    write(spark, tmp_path / "in", rows[30:], 1)
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out") == fold(rows)
    at = rows[-1][2]
    write(spark, tmp_path / "in", [(99, 1001, at + 5, "start"), (99, 1002, at + 9, "pause")], 2)
    write(spark, tmp_path / "in", [(99, 1003, at + 7, "resume")], 3)
    late = [r for r in run(spark, f"{tmp_path}/in", f"{tmp_path}/out") if r[0] == 99]
    assert sorted((r[2], r[3], r[5]) for r in late) == [(1001, "moved", "IN_PROGRESS"), (1002, "moved", "PENDING"), (1003, "late", "PENDING")]


def test_a_failed_batch_is_in_the_ledger_and_the_others_go_on(spark, tmp_path):
    for no in range(4):
        write(spark, tmp_path / "in", [(no, 10 * no + k, k, "start") for k in range(3)], no)
    broken = {1, 3}

    def work(batch):
        if broken & {r.task_id for r in batch.select("task_id").distinct().collect()}:
            raise ValueError("no\nsuch luck")
        return batch.select("task_id", "event_id")

    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    done, ledger = streams.attempted(stream(), work, "task_id long, event_id long", f"{tmp_path}/out")
    assert sorted(r.event_id for r in done.collect()) == [0, 1, 2, 20, 21, 22]
    assert {r.epoch: (r.error, [f.split("/")[-2] for f in r.files]) for r in ledger.collect()} == {1: ("ValueError: no", ["1"]), 3: ("ValueError: no", ["3"])}
    # The last epoch is run again, as after a crash before its commit, and passes now: it changes sides, and nothing is there twice.
    for name in ("3", ".3.crc"):
        os.remove(f"{tmp_path}/out/checkpoint/commits/{name}")
    broken.clear()
    done, ledger = streams.attempted(stream(), work, "task_id long, event_id long", f"{tmp_path}/out")
    assert sorted(r.event_id for r in done.collect()) == [0, 1, 2, 20, 21, 22, 30, 31, 32]
    assert [r.epoch for r in ledger.collect()] == [1]


def test_an_epoch_that_drain_runs_twice_is_there_once(spark, tmp_path):
    write(spark, tmp_path / "in", [(1, k, k, "start") for k in range(5)], 0)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*").select("event_id", F.lit(1).alias("one"))
    assert streams.drain(stream(), folder=f"{tmp_path}/out").count() == 5
    for name in ("0", ".0.crc"):
        os.remove(f"{tmp_path}/out/checkpoint/commits/{name}")
    assert streams.drain(stream(), folder=f"{tmp_path}/out").count() == 5


class Store:
    """A state store of one task that notes what it is asked."""

    def __init__(self):
        self.state, self.timers, self.asked = None, set(), []

    def __getattr__(self, name):
        def ask(*given):
            self.asked.append(name)
            if name in ("update", "clear"):
                self.state = given[0] if given else None
            elif name == "registerTimer":
                self.timers.add(given[0])
            elif name == "deleteTimer":
                self.timers.remove(given[0])
            return self if name == "getValueState" else self.state

        return ask


def test_a_task_has_one_timer_and_asks_its_store_for_no_more(spark):
    store, m, row = Store(), machine.Machine(), Row("at_ms", "event_id", "event")
    m.init(store)
    seen = lambda *rows: (store.asked.clear(), [r.kind for r in m.handleInputRows((1,), iter([row(*r) for r in rows]), None)], list(store.asked))[1:]
    assert seen((10, 2, "pause"), (5, 1, "start")) == (["moved", "moved"], ["get", "update", "registerTimer"])
    assert store.state == ("PENDING", 10) and store.timers == {10 + machine.IDLE_MS}
    assert seen((11, None, "nonsense"), (11, 3, "nonsense"), (11, None, "nonsense")) == (["illegal"] * 3, ["get"])
    assert seen((12, 4, "resume")) == (["moved"], ["get", "update", "deleteTimer", "registerTimer"])
    assert store.timers == {12 + machine.IDLE_MS}
    assert seen((12 + 3 * machine.IDLE_MS, 5, "nonsense")) == (["cancelled", "deleted", "illegal"], ["get", "clear", "deleteTimer"])
    assert store.state is None and not store.timers
