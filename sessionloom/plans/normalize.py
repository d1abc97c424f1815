"""Transcript lines to sessions: context, turns, tool calls, results, commands and file changes.

``lines`` has file, line_no and raw, one JSON record a line. Records of
unknown types are ignored; lines that don't parse are quarantined by
``parse_lines`` with their number.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.commands import is_test
from ..functions.text import trim_space
from ..functions.timeparse import lenient, seconds_between
from ..operators.matching import pair_first_in_first_out
from ..sources.tables import new_table, written

MAX_LINE = 10 << 20
KNOWN = ("session_start", "session_end", "user", "assistant", "tool_use", "tool_result")


@F.pandas_udf(T.StringType())
def _last_key_wins(raw: pd.Series) -> pd.Series:
    """Objects that repeat a key, as JSON with the last value; null if it doesn't parse at all."""

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(json.loads(x))
        except (TypeError, ValueError):
            return None

    return raw.map(one, na_action="ignore") if raw.notna().any() else raw


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with variant ``v``, quarantine with ``reason``), both written. Blank lines are neither.

    Every line is parsed once; only those that don't parse keep their text and
    are tried again with repeated keys allowed, and lie beside the others.
    """
    raw = F.col("raw")
    df = lines.withColumn("raw", trim_space(raw)).filter("raw <> ''").withColumn("v", F.when(F.octet_length(raw) <= MAX_LINE, F.try_parse_json(raw)))
    parts = [f"{new_table(lines.sparkSession)}/{part}" for part in ("once", "again")]
    once = written(df.withColumn("raw", F.when(F.col("v").isNull(), raw)), parts[0])
    odd = once.filter("raw IS NOT NULL").drop("v").withColumn("too_long", F.octet_length(raw) > MAX_LINE)
    again = written(odd.withColumn("v", F.try_parse_json(_last_key_wins(F.when(~F.col("too_long"), raw)))), parts[1])
    good = lines.sparkSession.read.schema(once.drop("raw").schema).parquet(*parts).filter("v IS NOT NULL")
    bad = again.filter("v IS NULL").select("file", "line_no", F.when(F.col("too_long"), "line too long").otherwise("not JSON").alias("reason"))
    return good, bad


def text_at(v: Column, *paths: str) -> Column:
    """First non-blank string at the paths, trimmed; values of other types are absent."""
    found = []
    for p in paths:
        inner = F.try_variant_get(v, p, "variant")
        found.append(F.when(F.schema_of_variant(inner) == "STRING", F.nullif(trim_space(F.try_variant_get(v, p, "string")), F.lit(""))))
    return F.coalesce(*found)


def bool_at(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def content_text(v: Column, path: str) -> Column:
    """A string, or the text parts of an array joined by line feeds, or the value as JSON."""
    inner = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(inner)
    array = F.try_variant_get(v, path, "array<variant>")
    parts = F.transform(array, lambda x: F.coalesce(text_at(x, "$.text"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
    joined = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
    return F.when(array.isNotNull(), joined).when(kind == "STRING", F.try_variant_get(v, path, "string")).when(inner.isNotNull() & (kind != "VOID"), F.to_json(inner))


def sessions(records: DataFrame) -> DataFrame:
    """One row per file: ids, times, model, context, git; the first or last non-blank in line order as each field asks."""
    v = F.col("v")
    kind, at = text_at(v, "$.type"), text_at(v, "$.timestamp")
    at = F.when(lenient(at).isNotNull(), at)
    df = records.withColumns({"type": kind, "at": at, "sid": text_at(v, "$.session_id", "$.sessionId"), "model": text_at(v, "$.message.model", "$.model"), "workspace_id": text_at(v, "$.workspace_id"), "repo_id": text_at(v, "$.repo_id"), "cwd": text_at(v, "$.cwd", "$.workspace.cwd")})
    kind_of_git = F.schema_of_variant(F.try_variant_get(v, "$.git", "variant"))
    sound = kind_of_git.isNull() | (kind_of_git == "VOID") | kind_of_git.startswith("OBJECT")  # a git of another type hides the line's flat fields
    git = {k: text_at(v, f"$.git.{k}", *flat) for k, flat in {"remote": ("$.git_remote",), "branch": ("$.git_branch",), "head_sha": ("$.git_head_sha", "$.head_sha")}.items()}
    df = df.withColumns({f"git_{k}": F.when(sound, c) for k, c in git.items()})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    of = lambda t, pick: pick("at", F.when((F.col("type") == t) & F.col("at").isNotNull(), F.col("line_no")))
    timed = F.when(F.col("at").isNotNull(), F.col("line_no"))
    out = df.groupBy("file").agg(
        F.min_by("sid", F.when(F.col("sid").isNotNull(), F.col("line_no"))).alias("transcript_session_id"),
        (F.min("sid") != F.max("sid")).alias("conflict"),
        F.coalesce(of("session_start", F.max_by), F.min_by("at", timed)).alias("started_at"),
        F.coalesce(of("session_end", F.max_by), F.max_by("at", timed)).alias("ended_at"),
        last("model"), last("workspace_id"), last("repo_id"), first("cwd"), first("git_remote"), first("git_branch"), first("git_head_sha"),
        F.count_if(F.col("type").isNotNull()).alias("n_records"),
    )
    duration = seconds_between(lenient(F.col("started_at")), lenient(F.col("ended_at")))
    problem = F.when(F.col("conflict"), "conflicting session ids").when(F.col("n_records") == 0, "empty transcript").when(duration < 0, "ends before it starts")
    return out.withColumns({"duration_seconds": duration, "problem": problem})


def blocks(records: DataFrame) -> DataFrame:
    """Turns, tool uses and tool results of all records, in order of (line_no, block_no)."""
    v, kind = F.col("v"), F.col("type")
    df = records.select("file", "line_no", "v", text_at(v, "$.type").alias("type"), text_at(v, "$.timestamp").alias("at"))
    body = F.coalesce(F.try_variant_get(v, "$.message.content", "variant"), F.try_variant_get(v, "$.content", "variant"))
    talk, spoken = kind.isin("user", "assistant"), text_at(v, "$.message.role")
    role = F.when(talk, F.when(spoken.isin("user", "assistant"), spoken).otherwise(kind)).otherwise("assistant")
    inner = F.when(talk, F.try_variant_get(body, "$", "array<variant>")).when(kind.isin("tool_use", "tool_result"), F.array(v))
    # outer: else the optimizer has every array made once more by a filter
    nested = df.select("file", "line_no", "at", role.alias("role"), F.posexplode_outer(inner).alias("block_no", "b")).filter("b IS NOT NULL")
    return nested.withColumn("kind", text_at(F.col("b"), "$.type"))


def turns(records: DataFrame) -> DataFrame:
    """(file, line_no, role, text, at): string content, or the texts of the blocks joined by line feeds."""
    v = F.col("v")
    df = records.withColumns({"type": text_at(v, "$.type"), "at": text_at(v, "$.timestamp")}).filter(F.col("type").isin("user", "assistant"))
    role = F.when(text_at(v, "$.message.role").isin("user", "assistant"), text_at(v, "$.message.role")).otherwise(F.col("type"))
    content = F.coalesce(content_text(v, "$.message.content"), content_text(v, "$.content"), text_at(v, "$.text"))
    return df.select("file", "line_no", role.alias("role"), content.alias("text"), "at").filter("text <> ''")


def tool_calls(records: DataFrame) -> DataFrame:
    """Calls with their results: file, position, call_id, name, input (JSON), at, result, success, result_at, matched.

    A result takes the open call of its id, else the oldest open call of its
    tool's name among results without a usable id, else it is a call of its
    own. ``position`` counts calls, results that are calls of their own
    included; calls without an id are named by it.
    """
    b = F.col("b")
    w = W.partitionBy("file").orderBy("line_no", "block_no")
    is_use, is_result = F.col("kind") == "tool_use", F.col("kind") == "tool_result"
    parts = blocks(records).filter(F.col("kind").isin("tool_use", "tool_result") & (is_result | (F.col("role") == "assistant")))
    call_input = F.to_json(F.coalesce(F.try_variant_get(b, "$.input", "variant"), F.parse_json(F.lit("{}"))))
    text = F.coalesce(F.nullif(content_text(b, "$.content"), F.lit("")), content_text(b, "$.output"))
    success = F.coalesce(bool_at(b, "$.success"), ~bool_at(b, "$.is_error"))
    parts = parts.select(
        "file", "line_no", "block_no", is_use.alias("is_use"), text_at(b, "$.tool_call_id", "$.tool_use_id", "$.id").alias("call_id"), F.coalesce(text_at(b, "$.name"), F.when(is_use, "unknown_tool")).alias("name"),
        F.when(is_use, call_input).alias("input"), F.when(is_result, text).alias("result"), F.when(is_result, success).alias("success"), "at",
    )
    # All keys below begin with the file, so its rows are shuffled once.
    parts = parts.withColumn("n", F.row_number().over(w)).drop("line_no", "block_no")
    same_id = W.partitionBy("file", "call_id")
    parts = parts.withColumns({"use_n": F.max(F.when(F.col("is_use"), F.col("n"))).over(same_id), "result_n": F.min(F.when(~F.col("is_use"), F.col("n"))).over(same_id)})
    by_id = F.col("call_id").isNotNull() & F.col("use_n").isNotNull() & F.col("result_n").isNotNull() & (F.col("n") == F.when(F.col("is_use"), F.col("use_n")).otherwise(F.col("result_n")))
    parts = parts.withColumn("by_id", F.coalesce(by_id, F.lit(False))).withColumn("queued", ~F.col("by_id") & F.col("name").isNotNull()).drop("use_n", "result_n")
    parts = pair_first_in_first_out(parts, ["file", "queued", "name"], ["n"], "is_use")
    pair = F.when(F.col("queued"), F.col("pair"))
    mate = {"m_id": F.when(F.col("by_id"), F.col("call_id")), "m_name": F.when(pair.isNotNull(), F.col("name")), "m_pair": pair}
    parts = parts.withColumns(mate).withColumn("mated", F.col("by_id") | F.col("m_pair").isNotNull()).drop("pair", "queued", "by_id")
    answer = F.lead(F.struct("result", "success", "at")).over(W.partitionBy("file", *mate).orderBy(F.desc("is_use")))  # a use and at most one result
    parts = parts.withColumn("answer", F.when(F.col("is_use"), answer)).filter(F.col("is_use") | ~F.col("mated"))
    placed = parts.withColumn("position", F.row_number().over(W.partitionBy("file").orderBy("n")))
    use = F.col("is_use")
    given = F.when(use, F.format_string("tool_%04d", "position")).otherwise(F.format_string("tool_result_%04d", "position"))
    found = {c: F.when(use, F.col(f"answer.{c}")).otherwise(F.col(c)) for c in ("result", "success", "at")}
    return placed.select(
        "file", "position", F.coalesce("call_id", given).alias("call_id"), F.coalesce("name", F.lit("ToolResult")).alias("name"), F.coalesce("input", F.lit("{}")).alias("input"), F.when(use, F.col("at")).alias("at"),
        found["result"].alias("result"), found["success"].alias("success"), found["at"].alias("result_at"), use.alias("matched"),
    )


def of_repo(rows: DataFrame, value: str) -> DataFrame:
    """Sessions whose repository, folder, remote, branch or revision is ``value``; all if it is blank."""
    if not value.strip():
        return rows
    same = reduce(lambda a, b: a | b, (F.coalesce(F.col(c) == value.strip(), F.lit(False)) for c in ("repo_id", "cwd", "git_remote", "git_branch", "git_head_sha") if c in rows.columns))
    return rows.filter(same)


def _with_ids(base: DataFrame, hook_ids: DataFrame | None) -> DataFrame:
    """The session's id, the transcript's own where it differs, and the event's time."""
    if hook_ids is not None:
        base = base.join(hook_ids.withColumnRenamed("file", "h_file"), F.col("file") == F.col("h_file"), "left").drop("h_file")
    else:
        base = base.withColumns({c: F.lit(None).cast("string") for c in ("hook_session_id", "event_type", "event_at")})
    session_id = F.coalesce("hook_session_id", "transcript_session_id")
    return base.withColumns({
        "session_id": session_id,
        "source_transcript_session_id": F.when(F.col("transcript_session_id") != session_id, F.col("transcript_session_id")),
        "event_at": F.coalesce("event_at", F.when(F.col("event_type") == "session_end", F.col("ended_at"))),
    }).filter("session_id IS NOT NULL")


def documents(records: DataFrame, hook_ids: DataFrame | None = None) -> DataFrame:
    """Sound sessions as one row each: ids, times, context and the counts of turns, calls, changes, commands and tests.

    ``hook_ids`` (file, hook_session_id, event_type, event_at) overrides a
    transcript's own id, which is then kept as ``source_transcript_session_id``;
    the time of a ``session_end`` event without one is the transcript's end.
    """
    base = _with_ids(sessions(records).filter("problem IS NULL"), hook_ids)
    command, (operation, path) = command_of(), change_of()
    calls = tool_calls(records).select("file", command.alias("command"), (operation.isNotNull() & path.isNotNull()).alias("changes"))
    counts = {"tool_calls": F.count("*"), "file_changes": F.count_if("changes"), "commands": F.count("command"), "tests": F.count_if(is_test(F.col("command")))}
    for rows, per in ((turns(records), {"turns": F.count("*")}), (calls, counts)):  # each read once
        base = base.join(rows.groupBy(F.col("file").alias("n_file")).agg(*(c.alias(name) for name, c in per.items())), F.col("file") == F.col("n_file"), "left").drop("n_file").fillna(0, list(per))
    return base.drop("conflict", "n_records", "problem")


#: What a session document says of itself.
SESSION_VERSION, SOURCE = "session.v1", "claude_code"


def session_rows(records: DataFrame, hook_ids: DataFrame | None = None) -> DataFrame:
    """Sound sessions as documents, one row each, with their turns, calls, changes and commands as arrays in order.

    Ids and times as in ``documents``; ``file`` is the transcript's path. A
    session's arrays are as long as its file.
    """
    base = _with_ids(sessions(records).filter("problem IS NULL"), hook_ids)
    calls = written(tool_calls(records))
    parts = {
        "turns": (turns(records), "line_no", {"role": "role", "timestamp": "at", "content": "text"}),
        "tool_calls": (calls, "position", {"tool_call_id": "call_id", "name": "name", "timestamp": "at", "input": "input", "success": "success", "result": "result", "result_timestamp": "result_at"}),
        "file_changes": (file_changes(calls), "position", {"path": "path", "operation": "operation", "timestamp": "at"}),
        "commands": (commands(calls), "position", {"command": "command", "timestamp": "at", "success": "success", "output": "output"}),
    }
    for name, (rows, place, fields) in parts.items():
        row = F.struct(place, F.struct(*(F.col(c).alias(k) for k, c in fields.items())).alias("r"))
        per = rows.groupBy(F.col("file").alias("n_file")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias(name))
        base = base.join(per, F.col("file") == F.col("n_file"), "left").drop("n_file").withColumn(name, F.coalesce(name, F.array().cast(per.schema[name].dataType.simpleString())))
    none = F.lit(None).cast("string")
    return base.select(
        "session_id", F.lit(SESSION_VERSION).alias("schema_version"), F.lit(SOURCE).alias("source"), F.col("model").alias("agent_model"), "workspace_id", "repo_id", F.col("file").alias("transcript_path"), "source_transcript_session_id",
        "cwd", "started_at", "ended_at", none.alias("source_event_id"), "git_remote", "git_branch", "git_head_sha", none.alias("provenance"), *parts,
    )


def command_of() -> Column:
    """The command of a call, null unless it is a shell call with one."""
    return F.when(F.lower("name") == "bash", F.nullif(trim_space(F.get_json_object("input", "$.command")), F.lit("")))


def change_of() -> tuple[Column, Column]:
    """Operation and path of a call; only one that has both changes a file."""
    low = F.lower("name")
    operation = F.when(low == "write", "write").when(low.isin("edit", "multiedit", "notebookedit"), "edit")
    return operation, F.when(operation.isNotNull(), F.coalesce(F.nullif(F.get_json_object("input", "$.file_path"), F.lit("")), F.nullif(F.get_json_object("input", "$.path"), F.lit(""))))


def commands(calls: DataFrame) -> DataFrame:
    return calls.filter(F.lower("name") == "bash").withColumn("command", command_of()).filter("command IS NOT NULL").select("file", "position", "at", "command", "success", F.col("result").alias("output"))


def file_changes(calls: DataFrame) -> DataFrame:
    operation, path = change_of()
    return calls.withColumns({"operation": operation, "path": path}).filter("operation IS NOT NULL AND path IS NOT NULL").select("file", "position", "at", "path", "operation")
