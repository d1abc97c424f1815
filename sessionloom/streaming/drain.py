"""Drain of an event spool: what is there now is processed once, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import payloads


def _rows(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Distinct keys that the table at ``path`` has, None if it isn't there yet."""
    try:
        return spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def drain_spool(spark: SparkSession, spool: str, out: str, checkpoint: str, line_payloads: bool = False) -> None:
    """Write sessions of a folder of JSON payloads (one a file, or one a line of text files) to the parquet table ``out`` and end.

    Of several events of a session the one of least file name counts; sessions
    that ``out`` already has are left alone, so a replayed batch changes
    nothing. Unsound payloads go to ``out``_quarantine, once by file as well. A second drain takes
    up only new files.
    """

    def process(batch: DataFrame, _: int) -> None:
        batch.persist()
        good = batch.filter("problem IS NULL").groupBy("session_id").agg(F.min_by(F.struct("file", "event_name", "event_type", "transcript_path", "cwd", "timestamp", "raw_missing"), "file").alias("r")).select("session_id", "r.*")
        if (done := _rows(spark, out, "session_id")) is not None:
            good = good.join(done, "session_id", "left_anti")
        good.write.mode("append").parquet(out)
        bad = batch.filter("problem IS NOT NULL").select("file", "session_id", "problem")
        if (seen := _rows(spark, out + "_quarantine", "file")) is not None:
            bad = bad.join(seen, "file", "left_anti")
        bad.write.mode("append").parquet(out + "_quarantine")
        batch.unpersist()

    files = spark.readStream.option("pathGlobFilter", "*.txt" if line_payloads else "*.json").text(spool, wholetext=not line_payloads).select("value", F.col("_metadata.file_name").alias("file"))
    payloads(files).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
