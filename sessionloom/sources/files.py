"""Readers of transcripts, payloads and files; writers of lines and content-addressed blobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.commands import is_safe_id
from ..functions.text import quoted, trim_space
from ..functions.timeparse import bad_time
from ..plans.vault import event_records

MAX_PAYLOAD = 1 << 20
MAX_BLOB = 50 << 20


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of JSON-lines transcripts below ``path``, line order kept within each file."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "raw"))


def transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length): transcripts outside folders named ``memory``; those below ``subagents`` are of their own kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).select("path", "length")
    kind = F.when(F.col("path").contains("/subagents/"), "subagent_transcript").otherwise("main_transcript")
    return files.filter(~F.col("path").contains("/memory/")).select("path", kind.alias("kind"), "length")


def payloads(raw: DataFrame, json: str = "value", capture_time: Column | None = None) -> DataFrame:
    """Hook payloads as events, with ``problem`` (null if sound): at most 1 MiB, an object whose fields are strings, then the rules of ``event_records``.

    A blank transcript_path is no fault: such an event's raw content is missing
    (``raw_missing``). ``event_name`` is the hook's name for the event.
    """
    v = F.try_parse_json(json)
    inner = {c: F.try_variant_get(v, f"$.{c}", "variant") for c in ("session_id", "transcript_path", "cwd", "hook_event_name", "timestamp")}
    text = {c: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, f"$.{c}", "string")) for c, x in inner.items()}
    odd = reduce(lambda a, b: a | b, (F.coalesce(~F.schema_of_variant(x).isin("STRING", "VOID"), F.lit(False)) for x in inner.values()))
    body = (
        F.when(F.octet_length(json) > MAX_PAYLOAD, "payload too large")
        .when(trim_space(F.coalesce(F.col(json), F.lit(""))) == "", "payload empty")
        .when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) | odd, "not JSON")
    )
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if capture_time is None else capture_time
    told = event_records(raw.withColumns({**text, "_body": body}), now)
    return told.withColumns({"problem": F.coalesce("_body", "problem"), "raw_missing": F.col("transcript_path") == ""}).withColumnRenamed("hook_event_name", "event_name").drop("_body")


# What a stored event may say.
EVENT_VERSION, EVENT_SOURCE = "event.v1", "claude_code"
TIMESTAMP_SOURCES = ("", "hook_payload", "capture_time", "transcript_end")


def stored_events(raw: DataFrame, json: str = "value", file: str = "file") -> DataFrame:
    """Events as a spool keeps them (one JSON object a file), trimmed, with ``problem`` (null if sound).

    An event's file is named by its id; a transcript's path may be blank only if
    the event says that its raw content is missing.
    """
    get = lambda path: trim_space(F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit("")))
    paths = {"schema_version": "schema_version", "event_id": "event_id", "source": "source", "event_type": "event_type", "timestamp": "timestamp", "timestamp_source": "timestamp_source", "session_id": "session_ref.session_id", "transcript_path": "session_ref.transcript_path", "cwd": "workspace.cwd"}
    df = raw.withColumns({**{c: get(path) for c, path in paths.items()}, "raw_missing": F.coalesce(F.get_json_object(json, "$.raw.raw_missing") == "true", F.lit(False)), "digest": F.get_json_object(json, "$.raw.digest")})
    no = lambda c: F.col(c) == ""
    known = lambda c, what: F.concat(F.lit(f"unsupported {what} "), quoted(F.col(c)))
    problem = (
        F.when(~F.coalesce(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), F.lit(False)), "invalid capture event JSON")
        .when(F.col("schema_version") != EVENT_VERSION, known("schema_version", "schema_version"))
        .when(no("event_id"), "missing event_id")
        .when(~is_safe_id(F.col("event_id")), F.concat(F.lit("event_id "), quoted(F.col("event_id")), F.lit(" is not a safe artifact id")))
        .when(F.col(file) != F.concat("event_id", F.lit(".json")), F.concat(F.lit("filename "), quoted(F.col(file)), F.lit(" does not match event_id "), quoted(F.col("event_id"))))
        .when(F.col("source") != EVENT_SOURCE, known("source", "source"))
        .when(~F.col("event_type").isin("session_start", "session_end"), known("event_type", "event_type"))
        .when(no("timestamp"), "missing timestamp")
        .when(bad_time(F.col("timestamp")), "timestamp must be RFC3339")
        .when(~F.col("timestamp_source").isin(*TIMESTAMP_SOURCES), known("timestamp_source", "timestamp_source"))
        .when(no("session_id"), "missing session_ref.session_id")
        .when(no("transcript_path") & ~F.col("raw_missing"), "missing session_ref.transcript_path")
        .when(no("cwd"), "missing workspace.cwd")
    )
    return df.withColumn("problem", problem)


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def store_blobs(items: DataFrame, content: str, path: str) -> None:
    """Append contents whose digest the store lacks, one row per digest, in folders by the digest's first two digits."""
    spark = items.sparkSession
    new = items.filter(F.col(content).isNotNull() & (F.octet_length(content) <= MAX_BLOB)).select(F.sha2(F.col(content).cast("binary"), 256).alias("digest"), F.col(content).cast("binary").alias("content")).dropDuplicates(["digest"])
    try:
        have = spark.read.schema("digest string, content binary, prefix string").parquet(path).select("digest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(have, "digest", "left_anti")
    new.withColumn("prefix", F.substring("digest", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
