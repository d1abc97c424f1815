"""The ``events`` table as transcript lines: what a session recorder would have written, one JSON record a line.

Each session of ``activity`` is a file. Its first line starts it, its last one
ends it; between them every event has three lines. The mapping is ours and
gives every form of record that normalization knows: calls within messages and
as records of their own, results found by id, by the name of their tool, or
not at all, context in several places, unknown records, blank lines and lines
that are no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import activity as A


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def transcripts(rows: DataFrame) -> DataFrame:
    """(file, line_no, raw) of ``activity`` rows, which are read once; lines are made where a session's rows lie."""
    k, idx = F.col("k"), F.col("idx").cast("string")
    text = k.cast("string")
    lit, made = F.lit, lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    command, success = A.command_run()
    what = F.when(F.col("event_type") == "click", A.changed_path()).otherwise(command)
    df = rows.withColumns({"what": what, "success": success, "n": F.max("idx").over(W.partitionBy("session_id"))})
    click, view = F.col("event_type") == "click", F.col("event_type") == "view"
    by_name, lost = ~click & (k % 4 == 0), ~click & (k % 4 == 1)
    use_id = F.when(~by_name, F.concat(lit("u"), idx))
    result_id = F.when(lost, F.concat(lit("x"), idx)).otherwise(use_id)
    tool = F.when(click, "Edit").when(lost, "bash").otherwise("Bash")
    call_input = F.struct(F.when(click, F.col("what")).alias("file_path"), F.when(~click, F.col("what")).alias("command"))
    use = F.struct(lit("tool_use").alias("type"), lit(None).cast("string").alias("text"), use_id.alias("id"), tool.alias("name"), call_input.alias("input"))
    said = F.struct(lit("text").alias("type"), F.concat(lit("edit "), text).alias("text"), lit(None).cast("string").alias("id"), lit(None).cast("string").alias("name"), F.when(lit(False), call_input).alias("input"))
    first_line = F.when(view, _json(type=lit("user"), timestamp=F.col("at"), message=F.struct(lit("user").alias("role"), F.concat(lit("look at "), text).alias("content"))))
    first_line = first_line.when(k % 97 == 0, F.concat(lit("{broken "), text)).when(k % 13 == 0, _json(type=lit("progress"), n=k)).otherwise(lit("  "))
    spoken = F.struct(lit("assistant").alias("role"), F.when(click, made("m", k % 3)).alias("model"), F.when(click, F.array(said, use)).otherwise(F.array(use)).alias("content"))
    fields = {
        "type": lit("assistant"), "timestamp": F.col("at"), "message": spoken, "cwd": F.when(click, made("/home/", k % 9)), "git_branch": F.when(click & (k % 5).isin(1, 2), F.when(k % 5 == 1, "skipped").otherwise(made("f", k % 4))),
        "git_head_sha": F.when(click & (k % 5 == 3), made("h", k)), "workspace_id": F.when(F.col("event_type") == "purchase", made("w", k % 7)), "repo_id": F.when(F.col("event_type") == "purchase", made("r", k % 3)),
    }
    told = F.when(click & (k % 5 == 1), _json(**fields, git=lit("none"))).otherwise(_json(**fields, git=F.when(click & (k % 5 == 0), F.struct(made("b", k % 4).alias("branch")))))
    second_line = F.when(view, F.to_json(use.withField("timestamp", F.col("at")))).otherwise(told)
    outcome = F.when(click, lit(True)).otherwise(F.col("success"))
    result = F.struct(
        lit("tool_result").alias("type"), result_id.alias("tool_use_id"), F.when(by_name, lit("Bash")).alias("name"), F.when(~view, F.when(click, "ok").otherwise(F.concat(lit("out "), text))).alias("content"), F.when(view, F.concat(lit("got "), text)).alias("output"),
        F.when(k % 4 != 3, ~outcome).alias("is_error"), F.when(k % 4 == 3, outcome).alias("success"),
    )
    third_line = F.when(view, F.to_json(result.withField("timestamp", F.col("at")))).otherwise(_json(type=lit("user"), timestamp=F.col("at"), message=F.struct(lit("user").alias("role"), F.array(result).alias("content"))))
    start = _json(type=lit("session_start"), session_id=F.col("session_id"), timestamp=F.col("at"), model=made("m", k % 3), workspace_id=made("w", F.col("user_id") % 7), workspace=F.when(k % 2 == 0, F.struct(made("/work/", F.col("user_id") % 5).alias("cwd"))))
    end = _json(type=lit("session_end"), sessionId=F.col("session_id"), timestamp=F.col("at"))
    known = F.col("event_type").isNotNull()
    parts = (F.when(F.col("idx") == 0, start), F.when(known, first_line), F.when(known, second_line), F.when(known, third_line), F.when(F.col("idx") == F.col("n"), end))
    # outer: else the optimizer has every array made once more by a filter
    lines = df.select("session_id", "idx", F.posexplode_outer(F.array(*parts)).alias("part", "raw")).filter("raw IS NOT NULL")
    return lines.select(F.col("session_id").alias("file"), F.when((F.col("part") == 0), 0).otherwise(3 * F.col("idx") + F.col("part")).alias("line_no"), "raw")
