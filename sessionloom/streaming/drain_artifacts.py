"""Drain of an event spool to the six artifacts of each session, committed together."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import artifacts as A
from ..plans import normalize
from ..sources.commits import commit, committed, is_committed
from ..sources.files import payloads
from ..sources.tables import written

TABLES = (*A.ARTIFACTS, "refused")


def existing(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, artifact) of what is committed below ``root``."""
    out = spark.createDataFrame([], "session_id string, artifact string")
    for name in A.ARTIFACTS:
        if (rows := committed(spark, root, name)) is not None:
            out = out.unionAll(rows.select("session_id", "artifact"))
    return out


def drain_artifacts(spark: SparkSession, spool: str, lines_of: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, line_payloads: bool = False, fail_fast: bool = False, imported: bool = False) -> None:
    """Process what is in the spool once: payloads to events, their transcripts to sessions, those to artifacts, a table each.

    ``lines_of`` gives (file, line_no, raw) of the transcripts named by events'
    ``transcript_path``. Sessions whose artifacts are all there are left alone; those with
    some are refused. What is refused (payloads, sessions) goes to the table
    ``refused`` of the same commit, or with ``fail_fast`` fails the drain, what earlier
    batches committed being kept. A batch is committed once, however often it
    runs; one that fails between two tables leaves none.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def stop_at(refused: DataFrame) -> None:
        if fail_fast and (first := refused.orderBy("session_id", "problem").first()) is not None:
            raise ValueError(f"{first.session_id}: {first.problem}")

    def process(batch: DataFrame, number: int) -> None:
        if is_committed(spark, root, f"{stream}-{number}"):
            return
        events = written(batch)
        bad = events.filter("problem IS NOT NULL").select(F.coalesce("session_id", F.lit("")).alias("session_id"), "problem")
        good = events.filter("problem IS NULL AND transcript_path <> ''").groupBy("session_id").agg(F.min_by(F.struct("transcript_path", "event_type", "timestamp"), "file").alias("r")).select("session_id", "r.*")
        missing = events.filter("problem IS NULL AND transcript_path = ''").select("session_id", F.lit("raw_missing").alias("problem"))
        state = written(A.completeness(good, existing(spark, root)))
        partial = state.filter("state = 'error'").select("session_id", F.concat(F.lit("partial artifacts, missing "), "missing").alias("problem"))
        early = written(bad.unionByName(missing).unionByName(partial))
        stop_at(early)
        todo = written(good.join(state.filter("state = 'process'").select("session_id"), "session_id", "left_semi"))
        hook_ids = todo.select(F.col("transcript_path").alias("file"), F.col("session_id").alias("hook_session_id"), "event_type", F.col("timestamp").alias("event_at"))
        records, _ = normalize.parse_lines(lines_of(todo))
        sessions = written(normalize.session_rows(records, hook_ids))
        made, refused = A.artifacts(sessions, imported)
        made = written(made)
        lost = todo.join(sessions.select("session_id"), "session_id", "left_anti").select("session_id", F.lit("no sound session in transcript").alias("problem"))
        refused = written(refused.unionByName(lost))
        stop_at(refused)
        refused = refused.unionByName(early)
        commit({**{a: made.filter(F.col("artifact") == a) for a in A.ARTIFACTS}, "refused": refused}, root, f"{stream}-{number}")

    files = spark.readStream.option("pathGlobFilter", "*.txt" if line_payloads else "*.json").text(spool, wholetext=not line_payloads).select("value", F.col("_metadata.file_name").alias("file"))
    payloads(files).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
