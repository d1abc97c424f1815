"""Trajectories: turns, calls, results and residual commands in order, as JSON lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeparse import order_key
from ..operators.matching import multiset_minus

# Fixed values.
FILE_TOOLS = ("read", "write", "edit", "multiedit", "notebookedit")
ALLOWED_KEYS = ("command", "description", "file_path", "path", "pattern", "query", "url", "limit", "offset")


def trajectory(records: DataFrame) -> DataFrame:
    """``records`` (session_id, class, ts, seq, ...) with ``position``: by time, untimed last, then by sequence."""
    w = W.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_last(), "seq")
    return records.withColumn("position", F.row_number().over(w))


def activity_records(changes: DataFrame, commands: DataFrame) -> DataFrame:
    """File edits as tool calls, commands as code actions with their outcome as observation, with a running sequence."""
    calls = changes.select("session_id", "ts", (F.col("idx") * 2).alias("seq"), F.lit("api_action").alias("class"), F.concat_ws(" ", "operation", "path").alias("content"))
    code = commands.select("session_id", "ts", (F.col("idx") * 2).alias("seq"), F.lit("code_action").alias("class"), F.col("command").alias("content"))
    seen = commands.filter("success IS NOT NULL").select("session_id", "ts", (F.col("idx") * 2 + 1).alias("seq"), F.lit("text_observation").alias("class"), F.when(F.col("success"), "success").otherwise("failure").alias("content"))
    return calls.unionByName(code).unionByName(seen)


def full_trajectory(turns: DataFrame, calls: DataFrame, commands: DataFrame) -> DataFrame:
    """(file, position, class, source, content) of whole sessions, from normalized rows.

    Turns are observations by user or agent, shell calls code actions, other
    calls actions of their name with the arguments that may leave; a result
    (text, time or outcome) is an observation by the environment. Commands
    beyond those of shell calls, time and text equal, follow with their output.
    Calls and commands without a text are left out. Order: time, what has none
    last, then turns, calls, commands as they came.
    """
    shell = F.lower("name") == "bash"
    code = F.nullif(F.trim(F.get_json_object("input", "$.command")), F.lit(""))
    row = lambda df, part, place, step, cls, source, content, time: df.select("file", order_key(F.col(time)).alias("t"), F.lit(part).alias("part"), F.col(place).cast("long").alias("place"), F.lit(step).alias("step"), cls.alias("class"), source.alias("source"), content.alias("content"))
    said = F.lit("TextObservation")
    talk = row(turns, 1, "line_no", 0, said, F.when(F.col("role") == "user", "user").otherwise("agent"), F.col("text"), "at")
    acts = row(calls.filter(~shell | code.isNotNull()), 2, "position", 0, F.when(shell, "CodeAction").otherwise("ApiAction"), F.when(shell, "shell").otherwise(F.col("name")), F.when(shell, code).otherwise(kwargs(F.col("name"), F.when(shell, "{}").otherwise(F.col("input")))), "at")
    seen = calls.filter(F.coalesce("result", F.lit("")).isin("") == F.lit(False)).unionByName(calls.filter((F.coalesce("result", F.lit("")) == "") & (F.col("success").isNotNull() | F.col("result_at").isNotNull())))
    answers = row(seen, 2, "position", 1, said, F.lit("environment"), F.coalesce("result", F.lit("")), "result_at")
    used = calls.filter(shell).select("file", "at", code.alias("command"))
    rest = multiset_minus(commands, used, ["file", "at", "command"], ["position"]).filter("command <> ''")
    more = row(rest, 3, "position", 0, F.lit("CodeAction"), F.lit("shell"), F.col("command"), "at")
    out = row(rest.filter("output <> '' OR success IS NOT NULL"), 3, "position", 1, said, F.lit("environment"), F.coalesce("output", F.lit("")), "at")
    whole = talk.unionByName(acts).unionByName(answers).unionByName(more).unionByName(out)
    place = F.row_number().over(W.partitionBy("file").orderBy(F.col("t.us").isNull(), "t", "part", "place", "step"))
    return whole.select("file", place.alias("position"), "class", "source", "content")


def json_lines(ordered: DataFrame) -> DataFrame:
    """One JSON line per session."""
    record = F.struct("position", F.struct(F.col("class").alias("class_"), "content").alias("r"))
    per = ordered.groupBy("session_id").agg(F.array_sort(F.collect_list(record)).alias("records"))
    body = F.struct(F.col("session_id").alias("id"), F.transform("records", lambda x: x["r"]).alias("content"), F.struct(F.lit("1.1.0").alias("version"), F.lit("corpus").alias("data_class")).alias("details"))
    return per.select("session_id", F.to_json(body).alias("line"))


def _allowed(value: object) -> object:
    if isinstance(value, dict):
        return {k: _allowed(v) for k, v in value.items() if k.strip().lower() in ALLOWED_KEYS}
    return [_allowed(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def _allow_keys(inputs: pd.Series) -> pd.Series:
    """Objects with only the allowed keys, at every depth; keys sorted. Values that aren't JSON objects become empty ones."""

    def one(x: str | None) -> str:
        if not x or x == "{}":
            return "{}"
        try:
            value = json.loads(x)
        except ValueError:
            value = {}
        return json.dumps(_allowed(value) if isinstance(value, dict) else {}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return inputs.map(one)


def kwargs(name: Column, call_input: Column) -> Column:
    """Arguments of an exported call: file tools keep their path only (null without one), others the allowed keys."""
    path = lambda k: F.nullif(F.get_json_object(call_input, f"$.{k}"), F.lit(""))
    file_path, plain = path("file_path"), path("path")
    only = F.when(file_path.isNotNull(), F.to_json(F.struct(file_path.alias("file_path")))).when(plain.isNotNull(), F.to_json(F.struct(plain.alias("path"))))
    of_file = F.lower(F.trim(name)).isin(*FILE_TOOLS)
    return F.when(of_file, only).otherwise(_allow_keys(F.when(F.coalesce(~of_file, F.lit(True)), call_input)))
