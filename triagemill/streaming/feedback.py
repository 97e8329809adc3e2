"""Feedback as keyed state: the registers of each job by its latest events, whatever order these come in, forgotten after their retention."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from triagemill.operators.state import RETENTION_DAYS
from triagemill.operators.triage import EFFECTS, REGISTERS, judged

#: The time and number of the event that a register was set by; what a register holds before any.
_NEVER = (-1, -1)
_STATE = ", ".join(f"{r} int, {r}_ts long, {r}_event long" for r in REGISTERS) + ", latest long"


class Registers(StatefulProcessor):
    """One value a key: each register, and the event that set it. A timer after the key's latest event clears it."""

    def __init__(self, key: str, days: int):
        self.key, self.kept = key, timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("registers", _STATE)

    def _row(self, key, values: list[int], expired: bool) -> pd.DataFrame:
        return pd.DataFrame([{self.key: key[0], **dict(zip(REGISTERS, values)), "expired": expired}])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        values = [held[3 * i] for i in range(len(REGISTERS))] if held else [0] * len(REGISTERS)
        by = [(held[3 * i + 1], held[3 * i + 2]) for i in range(len(REGISTERS))] if held else [_NEVER] * len(REGISTERS)
        latest = held[-1] if held else -1
        for part in rows:
            for ts, event_id, event in zip(part["ts"], part["event_id"], part["event"]):
                at = (int(pd.Timestamp(ts).value // 1000), int(event_id))
                latest = max(latest, at[0])
                for i, effect in enumerate(EFFECTS.get(event, ())[: len(REGISTERS)]):
                    if effect is not None and at > by[i]:
                        values[i], by[i] = effect, at
        self.held.update((*(x for i in range(len(REGISTERS)) for x in (values[i], *by[i])), latest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest // 1000 + int(self.kept.total_seconds() * 1000))
        yield self._row(key, values, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield self._row(key, [0] * len(REGISTERS), True)

    def close(self) -> None:
        pass


def keep_feedback(log: DataFrame, key: str = "job_id", days: int = RETENTION_DAYS, late: str = "1 day") -> DataFrame:
    """A stream (output mode update) of each key's registers after its new events, and the category and reason that follow; and a last row
    with `expired` once the watermark is `days` past the key's latest event. `log`: key, ts, event_id, event.

    Needs `spark.sql.streaming.stateStore.providerClass` to be the RocksDB one."""
    events = log.withWatermark("ts", late)
    schema = f"{key} {log.schema[key].dataType.simpleString()}, " + ", ".join(f"{r} int" for r in REGISTERS) + ", expired boolean"
    told = events.groupBy(key).transformWithStateInPandas(Registers(key, days), schema, "update", "eventTime")
    return judged(told)


def learned_counts(found: DataFrame, key: str = "job_id", late: str = "90 days") -> DataFrame:
    """Running (skill, occurrences, weight) over a stream of skills found in jobs (key, ts, skill, weight), output mode update. A skill counts once
    for a job however often it is found there, so that learning anew adds nothing."""
    once = found.withWatermark("ts", late).dropDuplicatesWithinWatermark([key, "skill"])
    return once.groupBy("skill").agg(F.count("*").alias("occurrences"), F.sum("weight").alias("weight"))


