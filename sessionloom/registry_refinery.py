"""Queries over whole sessions: redacted, gated, turned to artifacts and committed together; stores, counts and contracts, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import activity as A
from .plans import artifacts as R
from .plans import gates, normalize
from .plans.redacted import not_redacted, redact_sessions
from .plans.transcripts import transcripts
from .registry import _ACT, _query, _table, ORACLES
from .registry_sessions import _SESSIONS, _records, review_cards
from .sources.tables import shared_dir, written


def _session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(normalize.session_rows(_records(spark, sf_dir)))


# -- events -------------------------------------------------------------------


@_query("""WITH e AS (SELECT event_id, event_id % 14 AS fault, 'evt_' || event_id AS id FROM events)
SELECT event_id, CASE fault WHEN 1 THEN 'unsupported schema_version "event.v0"' WHEN 2 THEN 'missing event_id' WHEN 3 THEN 'event_id "../' || id || '" is not a safe artifact id' WHEN 4 THEN 'filename "' || id || '.json" does not match event_id "' || id || 'x"'
  WHEN 5 THEN 'unsupported source "other"' WHEN 6 THEN 'unsupported event_type "stop"' WHEN 7 THEN 'missing timestamp' WHEN 8 THEN 'timestamp must be RFC3339' WHEN 9 THEN 'unsupported timestamp_source "guess"' WHEN 10 THEN 'missing session_ref.session_id'
  WHEN 11 THEN 'missing session_ref.transcript_path' WHEN 13 THEN 'missing workspace.cwd' END AS problem FROM e""")
def stored_event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of a spool, each with one of twelve faults or none; a blank path beside missing raw content is none."""
    from .sources.files import EVENT_SOURCE, EVENT_VERSION, stored_events

    fault = F.col("event_id") % 14
    one_of = lambda n, bad, good: F.when(fault == n, bad).otherwise(good)
    event = F.concat(F.lit("evt_"), F.col("event_id").cast("string"))
    given = F.when(fault == 3, F.concat(F.lit("../"), event)).when(fault == 4, F.concat(event, F.lit("x"))).when(fault != 2, event)
    session = F.struct(one_of(10, F.lit(" "), F.col("user_id").cast("string")).alias("session_id"), F.when(~fault.isin(11, 12), "t.jsonl").alias("transcript_path"))
    fields = {
        "schema_version": one_of(1, F.lit("event.v0"), F.lit(EVENT_VERSION)), "event_id": given, "source": one_of(5, F.lit("other"), F.lit(EVENT_SOURCE)), "event_type": one_of(6, F.lit("stop"), F.lit("session_end")),
        "timestamp": F.when(fault == 8, "2024-05-01").when(fault != 7, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "timestamp_source": one_of(9, F.lit("guess"), F.lit("hook_payload")), "session_ref": session,
        "workspace": F.struct(F.when(fault != 13, "/w").alias("cwd")), "raw": F.when(fault == 12, F.struct(F.lit(True).alias("raw_missing"))),
    }
    raw = _table(spark, sf_dir, "events").select("event_id", F.concat(event, F.lit(".json")).alias("file"), F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("value"))
    return stored_events(raw.withColumnRenamed("event_id", "n")).select(F.col("n").alias("event_id"), "problem")


# -- redaction of whole sessions ----------------------------------------------------


# What redaction makes of the transcripts: folders below /home are paths; times, branches and revisions are secrets as a whole.
_REDACTED = f"""WITH s AS ({_SESSIONS}), v AS (
  SELECT *, [x for x in [started_at, ended_at, git_branch, git_head_sha] if x IS NOT NULL] AS vals, coalesce(cwd LIKE '/home/%', false) AS local FROM s
), n AS (
  SELECT *, list_transform(vals, lambda x: '[REDACTED_SECRET_' || printf('%03d', len(list_distinct(vals[1:list_position(vals, x)]))) || ']') AS marks FROM v
)
SELECT file AS session_id, CASE WHEN local THEN '[REDACTED_PATH_001]' ELSE cwd END AS cwd, marks[list_position(vals, started_at)] AS started_at, marks[list_position(vals, ended_at)] AS ended_at, marks[list_position(vals, git_branch)] AS git_branch, marks[list_position(vals, git_head_sha)] AS git_head_sha,
  len(list_distinct(vals))::bigint AS secret_placeholders, local::int::bigint AS path_placeholders,
  concat_ws(chr(10), CASE WHEN local THEN 'redaction.path_redacted.0001 workspace.cwd [REDACTED_PATH_001]' END,
    'redaction.secret_detected.' || printf('%04d', 1 + local::int) || ' started_at ' || marks[list_position(vals, started_at)], 'redaction.secret_detected.' || printf('%04d', 2 + local::int) || ' ended_at ' || marks[list_position(vals, ended_at)],
    'redaction.secret_detected.' || printf('%04d', 3 + local::int) || ' git.branch ' || marks[list_position(vals, git_branch)], 'redaction.secret_detected.' || printf('%04d', 3 + local::int + (git_branch IS NOT NULL)::int) || ' git.head_sha ' || marks[list_position(vals, git_head_sha)]) AS findings
FROM n"""


def _finding_lines(summary: str) -> Column:
    return F.array_join(F.transform(f"{summary}.findings", lambda x: F.concat_ws(" ", x["id"], x["field"], F.array_join(x["placeholders"], ","))), "\n")


@_query(_REDACTED)
def redacted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts' sessions redacted as a whole, with their findings in order."""
    good, _ = redact_sessions(_session_rows(spark, sf_dir))
    return good.select("session_id", "cwd", "started_at", "ended_at", "git_branch", "git_head_sha", "redaction.secret_placeholders", "redaction.path_placeholders", _finding_lines("redaction").alias("findings"))


def document_sessions(docs: DataFrame) -> DataFrame:
    """Documents as session rows: their lines in turn are turns, nested tool inputs (their beginnings as keys) with results, and commands with output."""
    none = F.lit(None).cast("string")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    of = lambda i: F.filter(F.transform(lines, lambda x, n: F.when(n % 3 == i, x)), lambda x: x.isNotNull())
    call_input = lambda x: F.to_json(F.struct(F.struct(F.array(x).alias("lines"), F.create_map(F.concat(F.lit("k "), F.substring(x, 1, 80)), F.lit(1)).alias("by key")).alias("args"), F.lit(1).alias("n")))
    call = lambda x, i: F.struct(F.format_string("tool_%04d", i + 1).alias("tool_call_id"), F.lit("Run").alias("name"), none.alias("timestamp"), call_input(x).alias("input"), F.lit(True).alias("success"), F.substring(x, 5, 200).alias("result"), none.alias("result_timestamp"))
    home = F.concat(F.lit("/home/"), F.coalesce("source", F.lit("x")))
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("session_id"), F.lit(normalize.SESSION_VERSION).alias("schema_version"), F.lit(normalize.SOURCE).alias("source"), F.col("lang").alias("agent_model"), none.alias("workspace_id"), F.col("source").alias("repo_id"),
        F.concat(home, F.lit("/t.jsonl")).alias("transcript_path"), none.alias("source_transcript_session_id"), home.alias("cwd"), none.alias("started_at"), F.lit("2024-05-01T00:00:00Z").alias("ended_at"), none.alias("source_event_id"), none.alias("git_remote"), F.col("lang").alias("git_branch"), none.alias("git_head_sha"),
        F.to_json(F.struct(F.concat_ws("/", home, F.col("doc_id").cast("string")).alias("path"))).alias("provenance"), F.transform(of(0), lambda x: F.struct(F.lit("user").alias("role"), none.alias("timestamp"), x.alias("content"))).alias("turns"), F.transform(of(1), call).alias("tool_calls"),
        F.array(F.struct(F.concat(home, F.lit("/a.go")).alias("path"), F.lit("edit").alias("operation"), none.alias("timestamp"))).alias("file_changes"), F.transform(of(2), lambda x: F.struct(x.alias("command"), none.alias("timestamp"), F.lit(None).cast("boolean").alias("success"), F.concat(home, F.lit(" "), F.substring(x, 1, 100)).alias("output"))).alias("commands"),
    )


@_query()
def redacted_document_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sessions, redacted; the digests of what comes out, and findings by field. Held against a sequential reader in the tests."""
    good, refused = redact_sessions(document_sessions(_table(spark, sf_dir, "documents")))
    body = F.to_json(F.struct("turns", "tool_calls", "file_changes", "commands", "provenance", "cwd"))
    told = good.select("session_id", "redaction.secret_placeholders", "redaction.path_placeholders", F.sha2(_finding_lines("redaction"), 256).alias("findings_sha256"), F.sha2(body, 256).alias("session_sha256"), F.lit(None).cast("string").alias("problem"))
    return told.unionByName(refused, allowMissingColumns=True)


# -- gates ------------------------------------------------------------------------


@_query("""SELECT session_id, CASE fault WHEN 1 THEN 'pipeline_status "", want "redacted"' WHEN 2 THEN 'pipeline_status "normalized", want "redacted"' WHEN 3 THEN 'missing redaction summary' WHEN 4 THEN 'missing redaction summary' END AS problem
FROM (SELECT DISTINCT user_id || '_' || floor(date_diff('day', DATE '2024-01-01', ts::date) / 7)::bigint AS session_id, user_id % 6 AS fault FROM events)""")
def redacted_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, some of them raw or without a sound summary, at the gate before judging, review and export."""
    fault = F.col("user_id") % 6
    rows = A.activity(spark, sf_dir).select("session_id", "user_id").distinct()
    shown = rows.select(
        "session_id", F.when(fault == 2, "normalized").when(fault != 1, " redacted ").alias("pipeline_status"),
        F.when(fault != 3, F.struct(F.when(fault == 4, "raw").otherwise("redacted").alias("status"))).alias("redaction"),
    )
    good, bad = gates.split(shown, not_redacted(shown))
    return good.select("session_id", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("session_id", "problem"))


_PARTS_SQL = "WITH s AS (SELECT session_id, split_part(session_id, '_', 1)::bigint % 8 AS fault FROM (SELECT DISTINCT session_id FROM (" + ORACLES["session_list_view"] + ")))"


@_query(_PARTS_SQL + """ SELECT session_id, CASE fault WHEN 1 THEN 'redacted is missing' WHEN 2 THEN 'evidence is missing' WHEN 3 THEN 'review is missing' WHEN 4 THEN 'redacted is repeated' WHEN 5 THEN 'session is repeated' WHEN 6 THEN 'evidence is missing, review is repeated' END AS problem FROM s""")
def artifact_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions joined with their redacted form, evidence and review card: some parts absent, some there twice."""
    fault = F.split_part("session_id", F.lit("_"), F.lit(1)).cast("long") % 8
    ids = written(A.activity(spark, sf_dir).select("session_id").distinct())
    part = lambda absent, twice: ids.filter(~fault.isin(*absent)).select("session_id", F.explode(F.array_repeat(F.lit(1), F.when(fault.isin(*twice), 2).otherwise(1))).alias("n"))
    good, bad = gates.context({"session": part([], [5]), "redacted": part([1], [4]), "evidence": part([2, 6], []), "review": part([3], [6])})
    return good.select("session_id", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("session_id", "problem"))


# The transcripts lose the outcome of calls whose result names another id.
_LOST = _ACT.replace("CASE event_type WHEN 'error' THEN false WHEN 'signup'", "CASE WHEN k % 4 = 1 THEN NULL ELSE CASE event_type WHEN 'error' THEN false WHEN 'signup'").replace("END ELSE true END AS success", "END ELSE true END END AS success")


@_query(_LOST + """SELECT c.session_id, c.verdict, c.main_finding, c.n_findings::bigint AS n_findings, coalesce(w.n, 0)::bigint AS n_warnings FROM cards c LEFT JOIN (
  SELECT session_id, count(DISTINCT text) AS n FROM (SELECT session_id, missing AS text FROM found WHERE missing IS NOT NULL
    UNION ALL SELECT session_id, 'commands[' || row_number() OVER (PARTITION BY session_id ORDER BY idx) || '].success' || CASE WHEN success IS NULL THEN '' ELSE NULL END FROM commands)
  WHERE text IS NOT NULL GROUP BY session_id) w ON w.session_id = c.session_id""")
def redacted_review_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of redacted sessions that passed the gate, with their warnings."""
    redacted, _ = redact_sessions(_session_rows(spark, sf_dir))
    good, _ = gates.split(redacted, not_redacted(redacted))
    cards = R.Evidence(written(good)).cards()
    return cards.select("session_id", "verdict", "main_finding", F.col("n_findings").cast("long").alias("n_findings"), F.size("warnings").cast("long").alias("n_warnings"))


# -- artifacts ----------------------------------------------------------------------


_FILES = ", ".join(f"('{a}', '{v[0]}')" for a, v in R.ARTIFACTS.items())


@_query(_LOST + f""", ids AS (SELECT session_id, user_id % 10 AS fault FROM (SELECT DISTINCT session_id, user_id FROM act)), files(artifact, file) AS (VALUES {_FILES}),
lines AS (SELECT file AS session_id, count(*) AS n FROM ({ORACLES["full_trajectories"]}) GROUP BY file),
per AS (SELECT i.session_id, verdict, n_findings, coalesce(n, 0) AS n FROM ids i JOIN cards c ON c.session_id = i.session_id LEFT JOIN lines l ON l.session_id = i.session_id WHERE fault NOT IN (3, 4, 5))
SELECT session_id, artifact, 'sessions/' || session_id || '/' || file AS path,
  CASE artifact WHEN 'normalized_session' THEN 'normalized' WHEN 'redacted_session' THEN 'redacted' WHEN 'evidence_bundle' THEN n_findings::varchar WHEN 'review_card' THEN verdict WHEN 'html_report' THEN '7' ELSE n::varchar END AS detail, NULL AS problem FROM per, files
UNION ALL SELECT session_id, NULL, NULL, NULL, CASE fault WHEN 3 THEN 'raw_missing' WHEN 4 THEN 'no sound session in transcript' ELSE 'missing required field cwd' END FROM ids WHERE fault IN (3, 4, 5)""")
def session_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the transcripts' sessions drained to six artifacts each, committed together; some events lack a path, a transcript or a folder."""
    from .sources.commits import committed
    from .streaming.drain_artifacts import drain_artifacts

    rows = written(A.activity(spark, sf_dir))
    lines = written(transcripts(rows))
    fault = F.col("user_id") % 10
    fields = {"session_id": F.col("session_id"), "transcript_path": F.when(fault == 4, "gone.jsonl").when(fault != 3, F.col("session_id")), "cwd": F.when(fault != 5, "/w"), "hook_event_name": F.lit("SessionEnd")}
    base = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    rows.select("session_id", "user_id").distinct().select(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("value")).write.text(f"{base}/in")
    named = lambda todo: lines.join(todo.select(F.col("transcript_path").alias("file")).distinct(), "file", "left_semi")
    drain_artifacts(spark, f"{base}/in", named, f"{base}/out", f"{base}/checkpoint", line_payloads=True)
    get = lambda path: F.get_json_object("body", path)
    size = lambda path: F.json_array_length(get(path)).cast("string")
    detail = {"normalized_session": get("$.pipeline_status"), "redacted_session": get("$.redaction.status"), "evidence_bundle": size("$.findings"), "review_card": get("$.verdict"), "html_report": F.regexp_count("body", F.lit("<section ")).cast("string"), "export_line": size("$.content")}
    none = F.lit(None).cast("string")
    out = committed(spark, f"{base}/out", "refused").select("session_id", none.alias("artifact"), none.alias("path"), none.alias("detail"), "problem")
    for name, c in detail.items():
        out = out.unionByName(committed(spark, f"{base}/out", name).select("session_id", "artifact", "path", c.alias("detail"), none.alias("problem")))
    return out


_HAVE = "CASE (user_id * 7 + length(session_id)) % 9 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 6 END"


@_query(f"""WITH ids AS (SELECT session_id, {_HAVE} AS have FROM (SELECT DISTINCT user_id, user_id || '_' || floor(date_diff('day', DATE '2024-01-01', ts::date) / 7)::bigint AS session_id FROM events)),
files(n, file) AS (VALUES {", ".join(f"({i}, '{v[0]}')" for i, v in enumerate(R.ARTIFACTS.values()))})
SELECT session_id, CASE have WHEN 6 THEN 'skip' WHEN 0 THEN 'process' ELSE 'error' END AS state, CASE WHEN have IN (0, 6) THEN '' ELSE (SELECT string_agg(file, ',' ORDER BY n) FROM files WHERE n >= have) END AS missing FROM ids""")
def artifact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose artifacts are all, in part or not there."""
    ids = A.activity(spark, sf_dir).select("session_id", "user_id").distinct()
    place = (F.col("user_id") * 7 + F.length("session_id")) % 9
    have = F.when(place == 0, 0).when(place == 1, 3).when(place == 2, 5).otherwise(6)
    there = ids.select("session_id", F.explode(F.slice(F.array(*map(F.lit, R.ARTIFACTS)), F.lit(1), have)).alias("artifact"))
    return R.completeness(ids, there)


@_query(_ACT + """, ends AS (SELECT session_id, user_id, max("at") AS ended FROM act GROUP BY ALL)
SELECT e.session_id, CASE user_id % 3 WHEN 1 THEN 'start' ELSE ended END AS latest_at, verdict FROM ends e JOIN cards c ON c.session_id = e.session_id WHERE user_id % 3 <> 0 AND user_id % 7 <> 2""")
def imported_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported sessions that have a review card and evidence; a third is not imported, some lack a card, some an end."""
    ends = A.activity(spark, sf_dir).groupBy("session_id", "user_id").agg(F.max("at").alias("ended"))
    cards = review_cards(spark, sf_dir).select("session_id", "verdict")
    rows = written(ends.join(cards, "session_id"))
    user = F.col("user_id")
    session = F.to_json(F.struct(F.when(user % 3 == 0, "normalized").otherwise(R.IMPORTED).alias("pipeline_status"), F.lit("start").alias("started_at"), F.when(user % 3 == 1, " ").otherwise(F.col("ended")).alias("ended_at")))
    body = lambda artifact, body, on=F.lit(True): rows.filter(on).select("session_id", F.lit(artifact).alias("artifact"), body.alias("body"))
    stored = body("normalized_session", session).unionByName(body("review_card", F.to_json(F.struct("verdict")), user % 7 != 2)).unionByName(body("evidence_bundle", F.lit("{}")))
    return R.imported_sessions(stored)


# -- stores -------------------------------------------------------------------------


@_query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS digest FROM documents),
blobs AS (SELECT digest, 1 AS origin, NULL AS problem, strlen(text)::bigint AS size FROM d WHERE doc_id % 3 <> 2
  UNION ALL SELECT CASE doc_id % 50 WHEN 9 THEN 'x' ELSE digest END, 2, CASE doc_id % 50 WHEN 7 THEN 'content does not match digest' WHEN 8 THEN 'content missing' WHEN 9 THEN 'digest is not 64 lower-case hexadecimal digits' END, strlen(text) FROM d WHERE doc_id % 3 <> 0)
SELECT digest, min(origin) AS origin, any_value(size) AS size, NULL AS problem FROM blobs WHERE problem IS NULL GROUP BY digest UNION ALL SELECT digest, origin, NULL, problem FROM blobs WHERE problem IS NOT NULL""")
def store_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores of documents' texts with a third in common merged; the second has blobs that are not what they say."""
    from .plans.store import digest_of, merged

    docs = _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    fault = F.col("doc_id") % 50
    first = docs.filter("doc_id % 3 <> 2").select(digest_of(F.col("text")).alias("digest"), F.col("text").cast("binary").alias("content"))
    wrong = F.when(fault == 7, F.concat("text", F.lit("x"))).when(fault != 8, F.col("text")).cast("binary")
    second = docs.filter("doc_id % 3 <> 0").select(F.when(fault == 9, "x").otherwise(digest_of(F.col("text"))).alias("digest"), wrong.alias("content"))
    good, bad = merged(first, second)
    told = good.select("digest", "origin", F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("string").alias("problem"))
    return told.unionByName(bad.select("digest", "origin", F.lit(None).cast("long").alias("size"), "problem"))


@_query("""WITH d AS (SELECT doc_id, doc_id % 8 AS kind, 't/' || doc_id AS transcript_path, sha256(coalesce(text, '')) AS hex FROM documents)
SELECT doc_id, CASE WHEN kind IN (0, 1) THEN 'live' WHEN kind IN (2, 3) THEN 'blob' END AS origin,
  CASE WHEN kind < 4 THEN hex END AS content_sha256, CASE kind WHEN 4 THEN 'missing transcript ' || transcript_path WHEN 5 THEN 'live transcript unavailable and event has no vault blob digest' WHEN 6 THEN 'event raw digest "sha256:f" is invalid'
    WHEN 7 THEN 'no blob blobs/' || substr('0' || substr(hex, 2), 1, 2) || '/' || '0' || substr(hex, 2) || 'z' END AS problem FROM d""")
def transcript_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts: unchanged, never captured, changed since, gone, and four ways in which no bytes can be had."""
    from .plans.store import digest_of, transcript_bytes

    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 8).alias("kind"), F.concat(F.lit("t/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    kind, hexed = F.col("kind"), digest_of(F.col("text"))
    given = F.when(kind.isin(0, 2, 3), F.concat(F.lit("sha256:"), hexed)).when(kind == 5, "md5:00").when(kind == 6, "sha256:f").when(kind == 7, F.concat(F.lit("sha256:0"), F.substring(hexed, 2, 70), F.lit("z")))
    events = docs.select("doc_id", F.col("path").alias("transcript_path"), given.alias("digest"))
    live = docs.filter("kind NOT IN (3, 4)").select("path", F.when(kind == 2, F.concat("text", F.lit("more"))).otherwise(F.col("text")).cast("binary").alias("content"))
    blobs = docs.filter("kind IN (2, 3)").select(hexed.alias("digest"), F.col("text").cast("binary").alias("content"))
    return transcript_bytes(events, live, blobs).select("doc_id", "origin", F.sha2("content", 256).alias("content_sha256"), "problem")


@_query("""WITH d AS (SELECT doc_id, 'raw_' || doc_id % 100 AS raw_id, sha256(coalesce(text, '')) AS digest FROM documents),
known AS (SELECT raw_id, digest FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY doc_id) AS n FROM d WHERE doc_id % 100 < 30) WHERE n = 1),
first AS (SELECT raw_id, arg_min(digest, doc_id) AS digest, min(doc_id) AS doc_id FROM d GROUP BY raw_id), holder AS (SELECT f.raw_id, coalesce(k.digest, f.digest) AS digest, k.raw_id IS NULL AS fresh FROM first f LEFT JOIN known k ON k.raw_id = f.raw_id)
SELECT raw_id, digest, NULL AS doc_id, NULL AS problem FROM known UNION ALL SELECT f.raw_id, f.digest, f.doc_id, NULL FROM first f JOIN holder h ON h.raw_id = f.raw_id AND h.fresh
UNION ALL SELECT d.raw_id, d.digest, d.doc_id, 'raw ref ' || d.raw_id || ' is of digest ' || h.digest || ', not ' || d.digest FROM d JOIN holder h ON h.raw_id = d.raw_id AND h.digest <> d.digest""")
def ref_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs of documents under a hundred ids, thirty of them known before: first writers win, other digests are refused."""
    from .plans.store import digest_of, upserted

    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("raw_"), (F.col("doc_id") % 100).cast("string")).alias("raw_id"), digest_of(F.coalesce("text", F.lit(""))).alias("digest"))
    known = docs.filter("doc_id % 100 < 30").groupBy("raw_id").agg(F.min_by("digest", "doc_id").alias("digest")).withColumn("doc_id", F.lit(None).cast("long"))
    refs, refused = upserted(written(known), docs, ["doc_id"])
    return refs.withColumn("problem", F.lit(None).cast("string")).unionByName(refused)


@_query("""SELECT 'vault_' || user_id % 5 AS vault, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) AS last_capture_at, count(*) AS captured, count(*) FILTER (WHERE event_type = 'error') AS raw_missing, count(*) FILTER (WHERE event_type = 'signup') AS copy_failures FROM events GROUP BY ALL""")
def capture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as captures in a spool of several files, counted by a stateful stream a file at a time."""
    from .streaming.capture_state import capture_states, drain_captures

    base = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    outcome = F.when(F.col("event_type") == "error", "missing").when(F.col("event_type") == "signup", "failed").otherwise("copied")
    rows = _table(spark, sf_dir, "events").select(F.concat(F.lit("vault_"), (F.col("user_id") % 5).cast("string")).alias("vault"), F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), outcome.alias("outcome"))
    rows.repartition(4, "event_id").write.json(f"{base}/in")
    drain_captures(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", files_per_batch=1)
    return capture_states(spark.read.parquet(f"{base}/out"))


# -- contracts ----------------------------------------------------------------------


_BROKEN = """(VALUES (0, 0, ''), (0, 1, '$.session_ref: required'), (0, 2, '$.event_type: enum'), (0, 3, '$.timestamp: type'), (0, 4, '$.colour: additional'), (0, 5, '$.source: const'), (0, 6, '$.workspace.cwd: required'),
  (1, 0, ''), (1, 1, '$.observed_at: required'), (1, 2, '$.kind: enum'), (1, 3, '$.size_bytes: type'), (1, 4, '$.colour: additional'), (1, 5, '$.local_only: const'), (1, 6, ''),
  (2, 0, ''), (2, 1, '$.main_finding: required'), (2, 2, '$.verdict: enum'), (2, 3, '$.evidence: type'), (2, 4, '$.colour: additional'), (2, 5, '$.data_class: const'), (2, 6, '$.warnings[]: type'),
  (3, 0, '$: no JSON object'), (3, 1, '$.schema_version: required'), (3, 2, '$.schema_version: unknown "other.v9"'), (3, 3, '$: no JSON object'), (3, 4, ''), (3, 5, '$.copy_failures: type'), (3, 6, ''))"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, body): the events as documents of four kinds, each with one of six faults or none."""
    kind, fault = F.col("event_id") % 4, (F.col("event_id") / 4).cast("long") % 7
    text = F.col("event_id").cast("string")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    unless = lambda n, c: F.when(fault != n, c)
    either = lambda n, bad, good: F.when(fault == n, bad).otherwise(good)
    extra = F.when(fault == 4, "red")
    event = F.struct(F.lit("event.v1").alias("schema_version"), F.concat(F.lit("evt_"), text).alias("event_id"), either(5, F.lit("other"), F.lit("claude_code")).alias("source"), either(2, F.lit("stop"), F.lit("session_end")).alias("event_type"), unless(3, at).alias("timestamp"), F.when(fault == 3, 5).alias("timestamp_n"),
                     unless(1, F.struct(text.alias("session_id"))).alias("session_ref"), F.struct(unless(6, F.lit("/w")).alias("cwd")).alias("workspace"), extra.alias("colour"))
    ref = F.struct(F.lit(" raw_ref.v1 ").alias("schema_version"), F.lit("raw").alias("data_class"), text.alias("raw_ref_id"), F.lit("claude_code").alias("source"), either(2, F.lit("memory"), F.lit("main_transcript")).alias("kind"), F.sha2(text, 256).alias("digest"), either(3, F.lit(1.5), either(6, F.lit(2.0), F.lit(3.0))).alias("size_bytes"), unless(1, at).alias("observed_at"), (fault != 5).alias("local_only"), extra.alias("colour"))
    strings = lambda *x: F.array(*map(F.lit, x))
    card = F.struct(F.lit("review_card.v1").alias("schema_version"), either(5, F.lit("raw"), F.lit("review")).alias("data_class"), text.alias("session_id"), either(2, F.lit("fine"), F.lit("clean")).alias("verdict"), unless(1, F.lit("none")).alias("main_finding"), unless(3, strings("a", "b")).alias("evidence"), F.when(fault == 3, "a").alias("evidence_n"), F.lit("h").alias("suggested_next_habit"), unless(6, strings()).alias("warnings"), F.when(fault == 6, F.array(F.lit(1))).alias("warnings_n"), extra.alias("colour"))
    other = F.when(fault == 0, "{broken").when(fault == 1, '{"a":1}').when(fault == 2, '{"schema_version":"other.v9"}').when(fault == 3, "[1]").when(fault == 5, '{"schema_version":"vault_state.v1","copy_failures":"2"}').otherwise('{"schema_version":"vault_state.v1","copy_failures":2.0}')
    renamed = F.regexp_replace(F.when(kind == 0, F.to_json(event)).when(kind == 1, F.replace(F.to_json(ref), F.lit(" raw_ref.v1 "), F.lit("raw_ref.v1"))).when(kind == 2, F.to_json(card)), '"(timestamp|evidence|warnings)_n"', '"$1"')
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(renamed, other).alias("body"))


@_query(f"SELECT event_id, CASE WHEN k = 0 THEN 'schemas/event.v1.schema.json' WHEN k = 1 THEN 'schemas/raw_ref.v1.schema.json' WHEN k = 2 THEN 'schemas/review_card.v1.schema.json' WHEN f >= 4 THEN 'schemas/vault_state.v1.schema.json' END AS schema_file, problem AS violations FROM events JOIN {_BROKEN} v(k, f, problem) ON event_id % 4 = k AND (event_id // 4) % 7 = f")
def registry_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of mixed documents, each checked against the schema of its own version."""
    from .plans.contracts import routed

    return routed(_mixed(spark, sf_dir), "body").select("event_id", "schema_file", F.array_join("violations", "\n").alias("violations"))


def _usage_sql() -> str:
    from .plans.contracts import enum_values

    rows = ", ".join(f"('{v}', '{p}', '{x}')" for v, p, x in enum_values())
    return f"""WITH listed(schema_version, property, value) AS (VALUES {rows}), e AS (SELECT event_id % 4 AS k, (event_id // 4) % 7 AS f FROM events),
used AS (SELECT 'event.v1' AS v, 'event_type' AS p, 'session_end' AS x FROM e WHERE k = 0 AND f <> 2 UNION ALL SELECT 'raw_ref.v1', 'kind', 'main_transcript' FROM e WHERE k = 1 AND f <> 2 UNION ALL SELECT 'review_card.v1', 'verdict', 'clean' FROM e WHERE k = 2 AND f <> 2)
SELECT schema_version, property, value, count(v) AS n FROM listed LEFT JOIN used ON v = schema_version AND p = property AND x = value GROUP BY ALL"""


@_query(_usage_sql())
def enum_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the mixed documents use each value that a schema lists."""
    from .plans.contracts import enum_usage as usage

    return usage(_mixed(spark, sf_dir), "body")


_CLASSES = ("raw", "redacted", "review", "corpus", "published", "secret")


@_query(f"""WITH c(i, name) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(_CLASSES))}), pairs AS (SELECT event_type, a.name AS source_class, b.name AS target_class, a.i AS i, b.i AS j, count(*) AS n FROM events JOIN c a ON a.i = event_id % 6 JOIN c b ON b.i = (event_id // 6) % 6 GROUP BY ALL)
SELECT event_type, source_class, target_class, n, CASE WHEN i = 5 THEN 'unknown data class "secret"' WHEN j = 5 THEN 'unknown data class "secret"' WHEN j < i THEN 'data class falls from ' || source_class || ' to ' || target_class END AS problem FROM pairs""")
def data_class_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as moves of data between classes: which of them a lattice allows."""
    from .plans.contracts import reclassified

    at = lambda n: F.element_at(F.array(*map(F.lit, _CLASSES)), (n % 6 + 1).cast("int"))
    moved = _table(spark, sf_dir, "events").select("event_type", at(F.col("event_id")).alias("source_class"), at((F.col("event_id") / 6).cast("long")).alias("target_class"))
    return moved.groupBy("event_type", "source_class", "target_class").agg(F.count("*").alias("n")).withColumn("problem", reclassified(F.col("source_class"), F.col("target_class")))


# -- scorecards ---------------------------------------------------------------------


# Runs of a card a day: events of a type are a dimension's check, those with k below 3 its failures.
_RUNS = """WITH e AS (SELECT user_id % 5 AS card, ts::date AS day, event_type AS dimension, regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1)::bigint AS k FROM events),
checks AS (SELECT card, day, dimension, count(*) FILTER (WHERE k < 3) AS failures, count(DISTINCT k % 10) AS classes, count(*) FILTER (WHERE k >= 10) * 100 // count(*) AS recall FROM e GROUP BY ALL),
states AS (SELECT *, dimension IN ('view', 'error') AND (day(day) + card) % 4 = 0 AS known FROM checks),
runs AS (
  SELECT card, day, day(day) % 3 = card % 3 AS accepted, list(dimension ORDER BY dimension) FILTER (WHERE failures > 0 AND NOT known) AS blocking, list(dimension ORDER BY dimension) FILTER (WHERE known) AS reds, max(classes) AS class_count, min(recall) AS recall_percent FROM states GROUP BY card, day
), based AS (
  SELECT *, last_value(CASE WHEN accepted THEN {'r': coalesce(len(reds), 0), 'c': class_count, 'p': recall_percent} END IGNORE NULLS) OVER (PARTITION BY card ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM runs
), gaps AS (
  SELECT card, day, string_agg(dimension || CASE WHEN day(day) % 5 = 0 OR (dimension = 'view' AND card = 2) THEN ' KNOWN-RED lacks note, owner, or valid deadline' ELSE ' KNOWN-RED is past deadline' END, chr(10) ORDER BY dimension) AS said
  FROM (SELECT card, day, unnest(reds) AS dimension FROM runs) WHERE day(day) % 5 = 0 OR (dimension = 'view' AND card = 2) OR day + INTERVAL 12 HOUR > DATE '2024-01-16' + INTERVAL 24 HOUR GROUP BY ALL
), said AS (
  SELECT b.card, b.day, CASE WHEN coalesce(len(blocking), 0) > 0 THEN 'NOT-TRUSTED' WHEN coalesce(len(reds), 0) > 0 THEN 'TRUSTED-WITH-NAMED-GAPS' ELSE 'TRUSTED' END AS headline,
    concat_ws(chr(10), CASE WHEN len(blocking) > 0 THEN array_to_string(list_transform(blocking, lambda x: x || ' is BLOCKING-RED'), chr(10)) END, CASE WHEN coalesce(len(reds), 0) > last.r THEN 'KNOWN-RED count increased' END, g.said,
      CASE WHEN class_count < last.c THEN 'extended corpus class count shrank' END, CASE WHEN recall_percent < last.p THEN 'extended recall regressed' END) AS reasons
  FROM based b LEFT JOIN gaps g ON g.card = b.card AND g.day = b.day
)
SELECT card, day::varchar AS day, headline, reasons = '' AS passed, reasons FROM said"""


@_query(_RUNS)
def scorecard_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily runs of five cards, each against the latest accepted run before it, with named gaps, some of them without an owner or past their deadline."""
    from .plans import ratchet

    k = F.regexp_extract("props", r'"k":\s*(-?[0-9]+)', 1).cast("long")
    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("card"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("dimension"), k.alias("k"))
    checks = rows.groupBy("card", "day", "dimension").agg(F.count_if(F.col("k") < 3).alias("failures"), F.count_distinct(F.col("k") % 10).alias("classes"), F.expr("count_if(k >= 10) * 100 div count(*)").alias("recall"))
    dom = F.dayofmonth("day")
    gaps = F.col("dimension").isin("view", "error") & ((dom + F.col("card")) % 4 == 0)
    each = written(checks.withColumn("run", F.concat_ws("|", F.col("card").cast("string"), F.col("day").cast("string"))))
    known = each.filter(gaps).select(F.col("run").alias("card"), "dimension")
    told = ratchet.states(each.select(F.col("run").alias("card"), "dimension", "failures"), known).select(F.col("card").alias("r"), F.col("dimension").alias("d"), "state")
    red = F.struct("dimension", F.lit("a note").alias("note"), F.when((F.col("dimension") == "view") & (F.col("card") == 2), " ").otherwise("someone").alias("owner"), F.when(dom % 5 == 0, "soon").otherwise("2024-01-16").alias("deadline"))
    per = each.join(told, (F.col("run") == F.col("r")) & (F.col("dimension") == F.col("d"))).groupBy("card", "day").agg(
        F.collect_list(F.when(F.col("state") == ratchet.BLOCKING_RED, F.col("dimension"))).alias("blocking"), F.collect_list(F.when(F.col("state") == ratchet.KNOWN_RED, red)).alias("known_red"), F.max("classes").alias("class_count"), F.min("recall").alias("recall_percent")
    )
    runs = per.withColumns({"run_at": F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS"), "accepted": F.dayofmonth("day") % 3 == F.col("card") % 3})
    return ratchet.judged(runs).select("card", F.col("day").cast("string").alias("day"), "headline", "passed", "reasons")


# -- a vault's life -----------------------------------------------------------------


_RECEIPT = """'{"schema_version":"memory_import_receipt.v1","data_class":"redacted","tool":"memory_store","decision":"' || CASE doc_id % 6 WHEN 1 THEN 'maybe' ELSE 'denied' END || '","namespace":"n","content_class":"note","memory_ids":[' || CASE doc_id % 6 WHEN 2 THEN '1' ELSE '"m' || doc_id % 20 || '"' END || '],"supersedes":[],"received_at":"t"' || CASE doc_id % 6 WHEN 3 THEN ',"error_class":"namespace_forbidden"' ELSE '' END || '}'"""


@_query(f"""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/h/.claude/' WHEN 1 THEN '/h/.codex/' ELSE '/h/' END || printf('%08d', doc_id) AS path, {_RECEIPT} AS body FROM documents), j AS (
  SELECT *, sha256(body) AS digest, CASE doc_id % 6 WHEN 1 THEN 'invalid memory import receipt: $.decision: enum' WHEN 2 THEN 'invalid memory import receipt: $.memory_ids[]: type' WHEN 3 THEN 'memory import receipt has namespace_forbidden and is not archived' END AS problem FROM f
), known AS (SELECT DISTINCT digest FROM j WHERE doc_id % 20 = 4), r AS (SELECT *, row_number() OVER (PARTITION BY digest, problem IS NULL ORDER BY path) AS n FROM j)
SELECT doc_id, 'raw_' || digest AS raw_id, CASE doc_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' ELSE 'manual' END AS source, 'memory_import_receipt' AS kind, CASE WHEN problem IS NOT NULL THEN 'refused' WHEN n > 1 OR digest IN (SELECT digest FROM known) THEN 'deduped' ELSE 'archived' END AS outcome, problem FROM r""")
def archived_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each document archived under its kind: some break their contract, some are forbidden, many are the same."""
    from .plans import lifecycle

    n = F.col("doc_id") % 6
    receipt = F.to_json(F.struct(
        F.lit("memory_import_receipt.v1").alias("schema_version"), F.lit("redacted").alias("data_class"), F.lit("memory_store").alias("tool"), F.when(n == 1, "maybe").otherwise("denied").alias("decision"), F.lit("n").alias("namespace"), F.lit("note").alias("content_class"),
        F.array(F.concat(F.lit("m"), (F.col("doc_id") % 20).cast("string"))).alias("memory_ids"), F.array().cast("array<string>").alias("supersedes"), F.lit("t").alias("received_at"), F.when(n == 3, "namespace_forbidden").alias("error_class"),
    ))
    receipt = F.when(n == 2, F.regexp_replace(receipt, '"memory_ids":\\["[^"]*"\\]', '"memory_ids":[1]')).otherwise(receipt)
    folder = F.element_at(F.array(*map(F.lit, ("/h/.claude/", "/h/.codex/", "/h/", "/h/"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = _table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.format_string("%08d", "doc_id")).alias("path"), receipt.cast("binary").alias("content"))
    known = files.filter("doc_id % 20 = 4").select(F.sha2("content", 256).alias("digest"))
    return lifecycle.archived(files, known, lifecycle.RECEIPTS).select("doc_id", "raw_id", "source", "kind", "outcome", "problem")


@_query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS hex FROM documents),
asked AS (SELECT CASE doc_id % 12 WHEN 1 THEN '' WHEN 3 THEN 'raw_' || substr(hex, 2) WHEN 4 THEN hex WHEN 5 THEN 'raw_' || sha256(hex) ELSE 'raw_' || hex END AS raw_ref_id, CASE doc_id % 12 WHEN 2 THEN '' ELSE 'reason ' || doc_id % 5 END AS reason, doc_id % 12 AS fault, hex FROM d WHERE doc_id % 3 <> 0 OR doc_id % 12 = 3),
good AS (SELECT * FROM asked WHERE fault NOT BETWEEN 1 AND 5)
SELECT raw_ref_id, min(reason) AS reason, bool_or(hex IN (SELECT hex FROM d WHERE doc_id % 4 <> 0)) AS blob_removed, NULL AS problem FROM good GROUP BY raw_ref_id
UNION ALL SELECT raw_ref_id, reason, NULL, CASE fault WHEN 1 THEN 'missing raw_ref_id' WHEN 2 THEN 'missing erasure reason' WHEN 5 THEN 'no raw ref ' || raw_ref_id ELSE 'invalid raw_ref_id "' || raw_ref_id || '"' END FROM asked WHERE fault BETWEEN 1 AND 5""")
def erased_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to erase the texts of two documents of three; some can't be met, some blobs are gone already."""
    from .plans import lifecycle
    from .plans.store import digest_of

    docs = _table(spark, sf_dir, "documents").select("doc_id", digest_of(F.coalesce("text", F.lit(""))).alias("hex"))
    fault = F.col("doc_id") % 12
    own = F.concat(F.lit("raw_"), "hex")
    given = F.when(fault == 1, "").when(fault == 3, F.concat(F.lit("raw_"), F.substring("hex", 2, 70))).when(fault == 4, F.col("hex")).when(fault == 5, F.concat(F.lit("raw_"), F.sha2("hex", 256))).otherwise(own)
    asked = docs.filter("doc_id % 3 <> 0 OR doc_id % 12 = 3").select(given.alias("raw_ref_id"), F.when(fault == 2, " ").otherwise(F.concat(F.lit("reason "), (F.col("doc_id") % 5).cast("string"))).alias("reason"))
    stones, refused = lifecycle.erased(asked, docs.select(own.alias("raw_ref_id"), F.col("hex").alias("digest")), docs.filter("doc_id % 4 <> 0").select(F.col("hex").alias("digest")), "2024-06-30T00:00:00Z")
    return stones.select("raw_ref_id", "reason", "blob_removed", F.lit(None).cast("string").alias("problem")).unionByName(refused, allowMissingColumns=True)


@_query("""WITH f AS (SELECT coalesce(source, '-') AS vault, CASE WHEN doc_id % 2 = 0 AND coalesce(source, '-') <> 'src1' THEN 'raw/' ELSE 'sessions/' END AS head, doc_id FROM documents), v AS (SELECT vault, count(*) AS n, bool_or(head = 'raw/') AS raw FROM f GROUP BY vault),
p AS (SELECT *, CASE vault WHEN 'src2' THEN '' WHEN 'src4' THEN vault ELSE '/backup/' || vault END AS destination FROM v), j AS (
  SELECT *, CASE WHEN destination = '' THEN 'missing backup destination' WHEN destination = vault THEN 'backup destination must differ from the vault' WHEN raw AND vault = 'src3' THEN 'backup includes raw vault bytes; confirm that the destination is approved' END AS problem FROM p)
SELECT vault, destination, CASE WHEN problem IS NULL THEN n ELSE 0 END AS file_count, problem IS NULL AND raw AS raw_egress, CASE WHEN problem IS NULL AND raw THEN '{"event":"raw_egress_ack","destination":"' || destination || '"}' END AS audit,
  problem IS NULL AND vault <> 'src5' AND vault <> 'src6' AS verified, problem FROM j""")
def vault_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault for each source of documents, backed up: some without a destination or consent, one with a changed file, one with a file too many."""
    from .plans import lifecycle

    vault = F.coalesce("source", F.lit("-"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", vault.alias("vault"), F.coalesce("text", F.lit("")).alias("text"))
    path = F.concat(F.when((F.col("doc_id") % 2 == 0) & (F.col("vault") != "src1"), "raw/").otherwise("sessions/"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", "vault", path.alias("path"), F.col("text").cast("binary").alias("content"))
    first = written(files.groupBy("vault").agg(F.min("doc_id").alias("least")).select(F.col("vault").alias("f_vault"), "least"))  # a row a vault
    copies = files.join(first, F.col("vault") == F.col("f_vault")).withColumn("content", F.when((F.col("vault") == "src5") & (F.col("doc_id") == F.col("least")), F.lit("changed").cast("binary")).otherwise(F.col("content"))).select("vault", "path", "content")
    copies = copies.unionByName(first.filter("f_vault = 'src6'").select(F.col("f_vault").alias("vault"), F.lit("more").alias("path"), F.lit("x").cast("binary").alias("content")))
    consents = first.select(F.col("f_vault").alias("vault"), F.when(F.col("f_vault") == "src2", " ").when(F.col("f_vault") == "src4", F.col("f_vault")).otherwise(F.concat(F.lit("/backup/"), "f_vault")).alias("destination"), (F.col("f_vault") != "src3").alias("allow_raw"))
    return lifecycle.backed_up(files, copies, consents)


@_query("""WITH v AS (SELECT coalesce(lang, '-') AS vault, doc_id, sha256(coalesce(text, '')) AS digest FROM documents), s AS (SELECT DISTINCT vault FROM v UNION ALL SELECT 'empty')
SELECT s.vault, CASE WHEN count(digest) > 0 THEN 'present' ELSE 'missing' END AS home_state, count(DISTINCT digest) AS vault_blobs, count(DISTINCT digest) FILTER (WHERE doc_id % 3 = 0) AS vault_refs, CASE WHEN s.vault IN ('en', 'fr') THEN '2024-06-01T00:00:00Z' ELSE '-' END AS last_backfill_at, length(s.vault) AS copy_failures FROM s LEFT JOIN v ON v.vault = s.vault GROUP BY s.vault""")
def vault_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault for each language, and one that holds nothing."""
    from .plans import lifecycle
    from .plans.store import digest_of

    rows = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("vault"), digest_of(F.coalesce("text", F.lit(""))).alias("digest"))
    vaults = rows.select("vault").distinct().unionAll(spark.createDataFrame([("empty",)], "vault string"))
    states = vaults.select("vault", F.when(F.col("vault").isin("en", "fr"), "2024-06-01T00:00:00Z").otherwise(" ").alias("last_backfill_at"), F.length("vault").cast("long").alias("copy_failures"))
    return lifecycle.status(rows, rows.filter("doc_id % 3 = 0"), states)


_LINKED = {a: v for a, v in R.ARTIFACTS.items() if v[3]}


@_query(f"""WITH a(artifact, file, media_type, label) AS (VALUES {", ".join(f"('{a}', '{v[0]}', '{v[1]}', '{v[2]}')" for a, v in _LINKED.items())}), s AS (
  SELECT user_id || '_' || floor(date_diff('day', DATE '2024-01-01', ts::date) / 7)::bigint AS session_id, user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS started, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS ended, count(*) AS n FROM events GROUP BY ALL)
SELECT session_id || ':' || artifact AS artifact_id, session_id, artifact AS type, label, media_type, 'sessions/' || session_id || '/' || file AS href, 'sha256:' || sha256(artifact || n) AS digest, CASE user_id % 4 WHEN 0 THEN 'event' WHEN 1 THEN ended WHEN 2 THEN started END AS created_at FROM s, a""")
def session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five artifacts of each session that others may see, dated by the first of its times that isn't blank."""
    from .plans import lifecycle

    rows = written(A.activity(spark, sf_dir).groupBy("session_id", "user_id").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n")))
    file = F.element_at(F.create_map(*(F.lit(x) for k, v in R.ARTIFACTS.items() for x in (k, v[0]))), F.col("artifact"))
    body = F.concat("artifact", F.col("n").cast("string"))
    made = rows.select("session_id", "n", F.explode(F.array(*map(F.lit, R.ARTIFACTS))).alias("artifact")).select("session_id", "artifact", F.concat(F.lit("sessions/"), "session_id", F.lit("/"), file).alias("path"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("digest"))
    kind = F.col("user_id") % 4
    at = lifecycle.first_time(F.when(kind == 0, "event").otherwise(" "), F.lit(""), F.when(kind == 1, F.col("ended")), F.lit(None).cast("string"), F.when(kind == 2, F.col("started")))
    return lifecycle.links(made, rows.select("session_id", at.alias("created_at")))
