"""The ``events`` and ``conversations`` tables as sessions.

Events of a user within seven days from 2024-01-01 on are a session. With k
the number in ``props``: a click edits a file, an error is a failed build, a
purchase a successful verification, a signup a test that fails (of unknown
outcome where k ends in 0), a view a download. The mapping is ours; it gives
every rule both outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
    k = F.regexp_extract("props", r'"k":\s*(-?[0-9]+)', 1).cast("long")
    named = events.select("event_id", "user_id", "event_type", F.col("ts"), F.concat_ws("_", F.col("user_id").cast("string"), week.cast("string")).alias("session_id"), k.alias("k"))
    return named.withColumns({"idx": F.row_number().over(W.partitionBy("session_id").orderBy("ts", "event_id")) - 1, "at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")})


def changed_path() -> Column:
    k = F.col("k").cast("string")
    return F.when(F.col("k") % 4 == 0, F.concat(F.lit("src/f"), k, F.lit(".go"))).when(F.col("k") % 4 == 1, F.concat(F.lit("tests/f"), k, F.lit("_test.py"))).when(F.col("k") % 4 == 2, F.concat(F.lit("docs/f"), k, F.lit(".md"))).otherwise("go.mod")


def changes(rows: DataFrame) -> DataFrame:
    return rows.filter("event_type = 'click'").select("session_id", "idx", "ts", "at", changed_path().alias("path"), F.lit("edit").alias("operation"))


def command_run() -> tuple[Column, Column]:
    """Text and success of an event that is no click."""
    kind, k, fifth = F.col("event_type"), F.col("k").cast("string"), (F.col("k") % 5).cast("string")
    text = F.when(kind == "error", F.concat(F.lit("make build t"), fifth)).when(kind == "purchase", F.concat(F.lit("make verify t"), fifth)).when(kind == "signup", F.concat(F.lit("go test ./p"), k)).otherwise(F.concat(F.lit("curl u"), k))
    return text, F.when(kind == "error", False).when(kind == "signup", F.when(F.col("k") % 10 != 0, False)).otherwise(True)


def commands(rows: DataFrame) -> DataFrame:
    text, success = command_run()
    return rows.filter("event_type <> 'click'").select("session_id", "idx", "ts", "at", text.alias("command"), success.alias("success"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns with their observation source; other roles are unknown records and left out."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    source = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "agent")
    return talk.filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", source.alias("source"), F.coalesce("text", F.lit("")).alias("text"))
