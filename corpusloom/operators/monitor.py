"""Health of the sync job from its logs: runs, reports, manifest age, alerts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions.scale import running_sum

_END = r"^\[([^\]]*)\] ===== end \(exit=(-?\d+)\) ====="
_REPORT = r"^\[([^\]]*)\] \[([A-Z]+)\] (.*)$"


def parse_sync_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, kind, exit, level, message) of run ends and monitor reports; other lines are
    dropped. Times may be written with dashes or slashes; other columns are kept."""
    keep = [c for c in lines.columns if c != column]
    is_end, is_report = F.col(column).rlike(_END), F.col(column).rlike(_REPORT)
    stamp = F.replace(F.regexp_extract(column, r"^\[([^\]]*)\]", 1), F.lit("/"), F.lit("-"))
    return lines.where(is_end | is_report).select(
        *keep, F.try_to_timestamp(F.substring(stamp, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.when(is_end, "end").otherwise("report").alias("kind"),
        F.when(is_end, F.regexp_extract(column, _END, 2).cast("int")).alias("exit"),
        F.when(~is_end, F.regexp_extract(column, _REPORT, 2)).alias("level"),
        F.when(~is_end, F.regexp_extract(column, _REPORT, 3)).alias("message"),
    )


def _judge(df: DataFrame, name: str, bad: Column) -> DataFrame:
    n = df.agg(F.count("*").alias("checked"), F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).alias("failed"))
    return n.select(
        F.lit(name).alias("check"), F.when(F.col("failed") > 0, "FAIL").when(F.col("checked") > 0, "OK").otherwise("WARN").alias("status"), "checked", "failed",
    )


def run_health(log: DataFrame) -> DataFrame:
    """(check, status, checked, failed) over the last runs and the last reports. Any exit
    code but zero is a failure. `log` has a `line_no` giving its order."""
    last = lambda kind, n: log.where(F.col("kind") == kind).orderBy(F.col("line_no").desc()).limit(n)
    runs = _judge(last("end", K.RUNS_CHECKED), "runs", F.col("exit") != 0)
    reports = last("report", K.REPORTS_CHECKED)
    return runs.unionByName(_judge(reports, "reports", F.col("level").isin("WARN", "ERROR")))


def manifest_health(meta: DataFrame) -> DataFrame:
    """Judgement per manifest (name, updated_ms, entries, objects, now_ms): stale when older
    than half an hour, incomplete when rows and objects differ; overall is the worst."""
    age = F.floor((F.col("now_ms") - F.col("updated_ms")) / 60000)
    fresh = F.when(F.col("updated_ms").isNull() | (age > K.STALE_MINUTES), 1).otherwise(0)
    diff = F.col("entries") - F.col("objects")
    whole = F.when(diff == 0, 0).when(F.abs(diff) <= K.MANIFEST_WARN_DIFF, 1).otherwise(2)
    word = lambda c: F.element_at(F.array(F.lit("OK"), F.lit("WARN"), F.lit("FAIL")), c + 1)
    return meta.select(
        "name", age.alias("age_min"), diff.alias("diff"), word(fresh).alias("freshness"), word(whole).alias("completeness"),
        word(F.greatest(fresh, whole)).alias("overall"),
    )


def idle_level(tasks: DataFrame, now_ms: Column) -> DataFrame:
    """(task, idle_min, level) from (task, last_run_ms): a task that never ran is a warning."""
    idle = (now_ms - F.col("last_run_ms")) / 60000.0
    return tasks.select(
        "task", F.round(idle, 1).alias("idle_min"),
        F.when(F.col("last_run_ms").isNull(), "WARN").when(idle > K.IDLE_ERROR_MIN, "ERROR").when(idle > K.IDLE_WARN_MIN, "WARN").otherwise("INFO").alias("level"),
    )


# --- alerts -------------------------------------------------------------------------
DAY_MS = 86_400_000


def failure_counts(runs: DataFrame) -> DataFrame:
    """Runs (task, run_id, ts_ms, exit) with `streak`, the number of successes before the
    run, and `fails`, the failures in a row up to it. Runs of one streak are independent of
    all others, so streaks, not tasks, are what later steps work on; both counts are
    running sums by day that split long tasks."""
    order = ["ts_ms", "run_id"]
    block = F.floor(F.col("ts_ms") / DAY_MS)
    ok = F.when(F.col("exit") == 0, 1).otherwise(0)
    s = running_sum(runs, ["task"], block, order, ok, "_ok")
    s = s.withColumn("streak", F.col("_ok") - ok).drop("_ok")
    return running_sum(s, ["task", "streak"], block, order, 1 - ok, "fails").withColumn(
        "fails", F.when(F.col("exit") == 0, F.lit(0)).otherwise(F.col("fails"))
    )


class AlertState:
    """Failures in a row, whether an alert is open, and when the last one was sent."""

    __slots__ = ("fails", "alerted", "last")

    def __init__(self, fails=0, alerted=False, last=0):
        self.fails, self.alerted, self.last = fails, alerted, last

    def step(self, ts: int, code: int, threshold: int, repeat_ms: int):
        """Event of one run: `alert`, `repeat`, `recovery` or None."""
        if code == 0:
            event = "recovery" if self.alerted else None
            count, self.fails, self.alerted = self.fails, 0, False
            return event, count
        self.fails += 1
        event = None
        if not self.alerted and self.fails >= threshold:
            event = "alert"
        elif self.alerted and ts - self.last > repeat_ms:
            event = "repeat"
        if event:
            self.alerted, self.last = True, ts
        return event, self.fails


EVENT_SCHEMA = "task string, run_id bigint, ts_ms bigint, event string, fails bigint"


def alert_events(runs: DataFrame, threshold: int = K.ALERT_THRESHOLD, repeat_hours: int = K.ALERT_REPEAT_HOURS) -> DataFrame:
    """(task, run_id, ts_ms, event, fails): an alert at the threshold, repeats after some
    hours, a recovery at the success that ends an alerted streak. Each streak is read in
    time order as a stream of rows; nothing of it is held but the state."""
    repeat_ms = repeat_hours * 3_600_000
    s = failure_counts(runs).select("task", "streak", "run_id", "ts_ms", "exit")

    def job(batches):
        at, state = None, None
        for pdf in batches:
            out = []
            for task, streak, run_id, ts, code in zip(pdf["task"], pdf["streak"], pdf["run_id"], pdf["ts_ms"], pdf["exit"]):
                if (task, streak) != at:
                    at, state = (task, streak), AlertState()
                event, fails = state.step(ts, code, threshold, repeat_ms)
                if event:
                    out.append((task, run_id, ts, event, fails))
            yield pd.DataFrame(out, columns=["task", "run_id", "ts_ms", "event", "fails"])

    return s.repartition("task", "streak").sortWithinPartitions("task", "streak", "ts_ms", "run_id").mapInPandas(job, EVENT_SCHEMA)
