"""Lookups offered to an agent, and the audit of recorded tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X

NOTE_HEAD = 4000


def list_files(notes: DataFrame, prefix: str = "", limit: int = 20) -> DataFrame:
    df = notes.where(F.col("path").startswith(prefix + "/")) if prefix else notes
    return df.orderBy("path").limit(limit).select("path")


def note_head(requests: DataFrame, notes: DataFrame, chars: int = NOTE_HEAD) -> DataFrame:
    """(path, title, size, content, truncated, missing) per asked path."""
    asked = requests.select("path").distinct()
    return asked.join(notes.select("path", F.col("content").alias("_c")), "path", "left").select(
        "path", X.title_of(F.col("path")).alias("title"), F.length("_c").cast("bigint").alias("size"),
        F.substring("_c", 1, chars).alias("content"), (F.length("_c") > chars).alias("truncated"), F.col("_c").isNull().alias("missing"),
    )


def get_chunks(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, idx, heading, content, hash, missing) per asked chunk."""
    found = chunks.select("path", "idx", "heading", "content", "hash")
    return requests.select("path", "idx").distinct().join(found, ["path", "idx"], "left").withColumn("missing", F.col("content").isNull())


def kb_lookup(results: DataFrame, k: int = 5, chars: int = 300) -> DataFrame:
    """The first k search results of each query with short snippets."""
    return results.where(F.col("rank") <= k).select(
        "query_id", "rank", "path", "idx", "heading", "title", "score", F.substring("snippet", 1, chars).alias("snippet")
    )


_CALL = r"(?s)^(.*?)(?:<tool_call>(.*?)</tool_call>|```tool_call\n(.*?)\n```)"


def parse_tool_calls(replies: DataFrame, column: str = "text") -> DataFrame:
    """First tool call of every reply: thought (the text before it), tool and args as JSON
    text. The name and the arguments are accepted under several keys; replies without a
    call, with broken JSON or without a name give no row."""
    keep = [c for c in replies.columns if c != column]
    raw = replies.where(F.col(column).rlike(_CALL)).select(
        *keep, X.uni_trim(F.regexp_extract(column, _CALL, 1)).alias("thought"),
        F.trim(F.concat(F.regexp_extract(column, _CALL, 2), F.regexp_extract(column, _CALL, 3))).alias("_j"),
    )
    # a JSON text with anything after it is no JSON: put into brackets it must be one element
    raw = raw.where(F.json_array_length(F.concat(F.lit("["), "_j", F.lit("]"))) == 1)
    get = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object("_j", f"$.{k}"), F.lit("")) for k in keys])
    return raw.select(
        *keep, "thought", get("name", "tool", "function").alias("tool"), F.coalesce(get("args", "input", "parameters"), F.lit("{}")).alias("args")
    ).where(F.col("tool").isNotNull())


def trace_audit(calls: DataFrame, enabled: list[str] | None = None, max_steps: int = K.AGENT_MAX_STEPS) -> DataFrame:
    """Calls (session_id, step, tool, args) with flags: `stuck` repeats the call of the step
    before, `over` lies beyond the step limit, `known` and `enabled` judge the tool. The
    step before is found by an equi-join, so a long session is not one task's work."""
    before = calls.select("session_id", (F.col("step") + 1).alias("step"), F.col("tool").alias("_t"), F.col("args").alias("_a"))
    return calls.join(before, ["session_id", "step"], "left").select(
        *calls.columns,
        F.coalesce((F.col("tool") == F.col("_t")) & F.col("args").eqNullSafe(F.col("_a")), F.lit(False)).alias("stuck"),
        (F.col("step") > max_steps).alias("over"), F.col("tool").isin(*K.AGENT_TOOLS).alias("known"),
        F.col("tool").isin(*(K.AGENT_TOOLS if enabled is None else enabled)).alias("enabled"),
    )


def trace_outcomes(audit: DataFrame, max_steps: int = K.AGENT_MAX_STEPS) -> DataFrame:
    """(session_id, outcome, steps, refused): a session stops at its first repeated call or
    at the step limit; only the steps up to there count."""
    ends = audit.groupBy("session_id").agg(F.min(F.when(F.col("stuck"), F.col("step"))).alias("_s"), F.max("step").alias("_m"))
    last = F.least(F.coalesce("_s", F.lit(2**31 - 1)), F.col("_m"), F.lit(max_steps))
    ends = ends.select(
        "session_id", last.alias("steps"),
        F.when(F.col("_s") <= max_steps, "stuck").when(F.col("_m") >= max_steps, "step limit").otherwise("finished").alias("outcome"),
    )
    refused = audit.where(~F.col("enabled")).join(ends.select("session_id", "steps"), "session_id").where(F.col("step") <= F.col("steps"))
    counts = refused.groupBy("session_id").agg(F.count("*").alias("refused"))
    return ends.join(counts, "session_id", "left").select("session_id", "outcome", "steps", F.coalesce("refused", F.lit(0)).alias("refused"))
