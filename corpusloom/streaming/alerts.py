"""Alerts from a stream of run records; the same state machine as the batch form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from corpusloom import constants as K
from corpusloom.operators.monitor import EVENT_SCHEMA, AlertState

STATE_SCHEMA = "fails long, alerted boolean, last long"


def alert_stream(runs: DataFrame, threshold: int = K.ALERT_THRESHOLD, repeat_hours: int = K.ALERT_REPEAT_HOURS) -> DataFrame:
    """Runs (task, run_id, ts_ms, exit) as a stream to events. Records of one task are taken
    in time order within each micro-batch; batches must arrive in time order."""
    repeat_ms = repeat_hours * 3_600_000

    def step(key, frames, state):
        s = AlertState(*state.get) if state.exists else AlertState()
        pdf = pd.concat(list(frames)).sort_values(["ts_ms", "run_id"])
        out = []
        for run_id, ts, code in zip(pdf["run_id"], pdf["ts_ms"], pdf["exit"]):
            event, fails = s.step(int(ts), int(code), threshold, repeat_ms)
            if event:
                out.append((key[0], run_id, ts, event, fails))
        state.update((s.fails, s.alerted, s.last))
        yield pd.DataFrame(out, columns=["task", "run_id", "ts_ms", "event", "fails"])

    return runs.groupBy("task").applyInPandasWithState(step, EVENT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
