"""Content-addressed preservation: blobs, refs, tombstones, drift, backup checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space
from ..functions.timeparse import bad_time, stale
from ..operators.matching import first_writer

#: Bytes beyond which a content is not archived.
MAX_BLOB = 50 << 20
# Names under which a hook announces an event, kinds of archived files, folders that tell a recorder.
EVENT_TYPES = {"SessionStart": "session_start", "session_start": "session_start", "SessionEnd": "session_end", "session_end": "session_end"}
TRANSCRIPT_KINDS = ("main_transcript", "subagent_transcript")
KINDS = (*TRANSCRIPT_KINDS, "file_history_snapshot", "source_insight_report", "source_metadata", "source_export_bundle", "source_memory", "vendor_memory_dir", "vendor_insight_report", "memory_import_receipt", "unknown")
SOURCE_FOLDERS = {"/.claude/": "claude_code", "/.codex/": "codex"}


def event_id(*parts: Column) -> Column:
    """``evt_`` and 32 hexadecimal digits of the SHA-256 of NUL-terminated parts; nulls are empty."""
    ended = [x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.chr(F.lit(0)))]
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat(*ended), 256), 1, 32))


def blob_path(digest: Column) -> Column:
    return F.concat(F.lit("blobs/"), F.substring(digest, 1, 2), F.lit("/"), digest)


def source_of(path: Column) -> Column:
    """The recorder whose folder a path goes through, ``manual`` if none."""
    out = F.lit("manual")
    for folder, source in reversed(SOURCE_FOLDERS.items()):
        out = F.when(path.contains(folder), source).otherwise(out)
    return out


def kind_of(path: Column) -> Column:
    return F.when(path.contains("/subagents/"), TRANSCRIPT_KINDS[1]).otherwise(TRANSCRIPT_KINDS[0])


def event_records(payloads: DataFrame, capture_time: str | Column) -> DataFrame:
    """``payloads`` (session_id, transcript_path, cwd, hook_event_name, timestamp) as events, with ``problem`` (null if sound).

    Fields are trimmed. The time is the payload's, else that of the capture;
    ``timestamp_source`` says which.
    """
    fields = ("session_id", "transcript_path", "cwd", "hook_event_name", "timestamp")
    df = payloads.withColumns({c: trim_space(F.coalesce(F.col(c), F.lit(""))) for c in fields})
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in EVENT_TYPES.items() for x in kv)), F.col("hook_event_name"))
    problem = F.lit(None).cast("string")
    for c in ("hook_event_name", "cwd", "session_id"):
        problem = F.when(F.col(c) == "", f"missing required field {c}").otherwise(problem)
    problem = F.coalesce(problem, F.when(bad_time(F.col("timestamp")), "timestamp must be RFC3339"), F.when(kind.isNull(), F.concat(F.lit("unsupported event name "), "hook_event_name")))
    given = F.col("timestamp") != ""
    df = df.withColumns({"event_type": kind, "problem": problem, "timestamp_source": F.when(given, "hook_payload").otherwise("capture_time"), "timestamp": F.when(given, F.col("timestamp")).otherwise(capture_time)})
    return df.withColumn("event_id", event_id(F.lit("claude_code"), F.col("event_type"), F.col("session_id"), F.col("transcript_path"), F.col("cwd")))


def archive(items: DataFrame, item_id: str, content: str, max_bytes: int = MAX_BLOB) -> DataFrame:
    """(item_id, digest, size, path, outcome): the first writer of a digest copies, later ones are deduped. Null contents are missing, those over ``max_bytes`` failed."""
    size = F.octet_length(content).cast("long")
    rows = items.select(item_id, F.when(size <= max_bytes, F.sha2(F.col(content).cast("binary"), 256)).alias("digest"), size.alias("size"))
    have = first_writer(rows.filter("digest IS NOT NULL"), "digest", [item_id])
    gone = rows.filter("digest IS NULL").withColumn("outcome", F.when(F.col("size").isNull(), "missing").otherwise("failed"))
    return have.unionByName(gone).withColumn("path", blob_path(F.col("digest")))


def tallies(archived: DataFrame, group: str) -> DataFrame:
    """Per group: how many contents were copied, deduped, missing and failed, and the share of bytes that dedup saved."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return archived.groupBy(group).agg(*(count(o) for o in ("copied", "deduped", "missing", "failed")), F.coalesce(F.sum(F.when(F.col("outcome") == "deduped", F.col("size"))), F.lit(0)).alias("bytes_saved"))


def skip_reason(outcome: Column) -> Column:
    """Why an event's session isn't processed, null if it is."""
    return F.when(outcome == "missing", "raw_missing").when(outcome == "failed", "copy_failed")


def doctor(vaults: DataFrame, now: Column) -> DataFrame:
    """``vaults`` with ``backfill_status``, ``backup_status``, ``drift`` and ``warnings`` (in order, LF-joined, empty if none).

    Needs hook_installed, schedule_installed, last_backfill_at,
    last_backup_verified_at (RFC 3339 or blank), copy_failures, captured (the
    transcripts that events announced) and archived (refs of transcripts).
    """
    backfill = F.when(stale(F.col("last_backfill_at"), now), "stale").otherwise("ok")
    blank = trim_space(F.coalesce("last_backup_verified_at", F.lit(""))) == ""
    backup = F.when(blank, "missing_or_unverified").when(stale(F.col("last_backup_verified_at"), now), "stale").otherwise("verified")
    drift = F.col("captured") - F.col("archived")
    # The sentences.
    warnings = F.array_compact(F.array(
        F.when(~F.col("hook_installed"), "global SessionEnd hook is not installed"),
        F.when(~F.col("schedule_installed"), "preservation freshness depends on a schedule that is not installed"),
        F.when(backfill == "stale", "backfill is missing or stale"),
        F.when(backup == "missing_or_unverified", "backup has never been verified").when(backup == "stale", "verified backup is stale"),
        F.when(F.col("copy_failures") > 0, F.concat(F.lit("copy failures recorded: "), F.col("copy_failures").cast("string"))),
        F.when(drift > 0, "transcript drift heuristic indicates captured transcripts without refs"),
    ))
    shown = F.format_string("%+d (expected=%d archived=%d)", drift, "captured", "archived")
    return vaults.withColumns({"backfill_status": backfill, "backup_status": backup, "drift": shown, "warnings": F.array_join(warnings, "\n")})


def classify_blobs(blobs: DataFrame, refs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(digest, state): tombstoned, referenced or orphan."""
    r = refs.select(F.col("digest").alias("r_digest")).distinct()
    t = tombstones.select(F.col("digest").alias("t_digest")).distinct()
    df = blobs.select("digest").distinct().join(r, F.col("digest") == F.col("r_digest"), "left").join(t, F.col("digest") == F.col("t_digest"), "left")
    return df.select("digest", F.when(F.col("t_digest").isNotNull(), "tombstoned").when(F.col("r_digest").isNotNull(), "referenced").otherwise("orphan").alias("state"))


def without_tombstoned(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones.select("digest").distinct(), "digest", "left_anti")


def compare_backup(live: DataFrame, backup: DataFrame) -> DataFrame:
    """(path, state): ok, changed, missing in the backup, or extra in it."""
    a = live.select(F.col("path").alias("l_path"), F.col("digest").alias("l_digest"))
    b = backup.select(F.col("path").alias("b_path"), F.col("digest").alias("b_digest"))
    df = a.join(b, F.col("l_path") == F.col("b_path"), "full")
    state = F.when(F.col("b_path").isNull(), "missing").when(F.col("l_path").isNull(), "extra").when(F.col("l_digest") == F.col("b_digest"), "ok").otherwise("changed")
    return df.select(F.coalesce("l_path", "b_path").alias("path"), state.alias("state"))
