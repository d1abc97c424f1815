"""Queries over the ``events`` table written as transcripts and read back, and over facts, vault and contracts, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import activity as A
from .functions import commands as C
from .functions import text
from .functions.timeparse import stale
from .plans import export, findings, normalize, quality, vault
from .plans.transcripts import transcripts
from .registry import _ACT, _found, _query, _table, review_cards
from .sources.tables import written


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = normalize.parse_lines(transcripts(A.activity(spark, sf_dir)))
    return good


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.tool_calls(_records(spark, sf_dir))


# What the transcripts hold, from the events they were written of.
_SAID = _ACT + """, every AS (
  SELECT a.*, coalesce(c.path, m.command) AS what, CASE WHEN a.event_type = 'click' THEN true ELSE m.success END AS outcome,
    a.event_type <> 'click' AND k % 4 = 0 AS by_name, a.event_type <> 'click' AND k % 4 = 1 AS lost
  FROM act a LEFT JOIN changes c USING (session_id, idx) LEFT JOIN commands m USING (session_id, idx)
), placed AS (
  SELECT *, idx + 1 + coalesce(sum(lost::int) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS place,
    CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'got ' || k ELSE 'out ' || k END AS answer FROM every
), calls AS (
  SELECT session_id AS file, place AS position, CASE WHEN by_name THEN printf('tool_%04d', place) ELSE 'u' || idx END AS call_id,
    CASE WHEN event_type = 'click' THEN 'Edit' WHEN lost THEN 'bash' ELSE 'Bash' END AS name, CASE WHEN event_type = 'click' THEN '{"file_path":"' || what || '"}' ELSE '{"command":"' || what || '"}' END AS input,
    "at", CASE WHEN NOT lost THEN answer END AS result, CASE WHEN NOT lost THEN outcome END AS success, CASE WHEN NOT lost THEN "at" END AS result_at, true AS matched, what, ts, idx
  FROM placed
  UNION ALL SELECT session_id, place + 1, 'x' || idx, 'ToolResult', '{}', NULL, answer, outcome, "at", false, NULL, ts, idx FROM placed WHERE lost
), talk AS (
  SELECT session_id AS file, (3 * idx + CASE WHEN event_type = 'click' THEN 2 ELSE 1 END)::bigint AS line_no, CASE WHEN event_type = 'click' THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN event_type = 'click' THEN 'edit ' ELSE 'look at ' END || k AS text, "at", ts FROM act WHERE event_type IN ('click', 'view')
)
"""


@_query(_ACT + """SELECT session_id AS file, (3 * idx + 1)::bigint AS line_no, 'not JSON' AS reason FROM act WHERE event_type <> 'view' AND k % 97 = 0""")
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = normalize.parse_lines(transcripts(A.activity(spark, sf_dir)))[1]
    return bad.select("file", F.col("line_no").cast("long").alias("line_no"), "reason")


@_query(_ACT + """SELECT session_id AS file, count(*) FILTER (WHERE event_type = 'view') + count(*) FILTER (WHERE event_type <> 'view') AS user_records, count(*) FILTER (WHERE event_type <> 'view') AS assistant_records,
  count(*) FILTER (WHERE event_type = 'view') AS use_records, count(*) FILTER (WHERE event_type = 'view') AS result_records, count(*) FILTER (WHERE event_type <> 'view' AND k % 97 <> 0 AND k % 13 = 0) AS other_records FROM act GROUP BY session_id""")
def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by type; unknown types are there, and no part of a session."""
    kind = normalize.text_at(F.col("v"), "$.type")
    names = {"user_records": "user", "assistant_records": "assistant", "use_records": "tool_use", "result_records": "tool_result"}
    other = F.count_if(~kind.isin(*normalize.KNOWN)).alias("other_records")
    return _records(spark, sf_dir).groupBy("file").agg(*(F.count_if(kind == t).alias(c) for c, t in names.items()), other)


_SESSIONS = _ACT + """, first AS (SELECT session_id, user_id, k, "at" FROM act WHERE idx = 0)
SELECT a.session_id AS file, a.session_id AS transcript_session_id, min(f."at") AS started_at, max(a."at") AS ended_at, date_diff('microsecond', min(ts), max(ts)) // 1000000 AS duration_seconds,
  coalesce(arg_max('m' || (a.k % 3), idx) FILTER (WHERE event_type = 'click'), any_value('m' || (f.k % 3))) AS model,
  coalesce(arg_max('w' || (a.k % 7), idx) FILTER (WHERE event_type = 'purchase'), any_value('w' || (f.user_id % 7))) AS workspace_id, arg_max('r' || (a.k % 3), idx) FILTER (WHERE event_type = 'purchase') AS repo_id,
  coalesce(any_value(CASE WHEN f.k % 2 = 0 THEN '/work/' || (f.user_id % 5) END), arg_min('/home/' || (a.k % 9), idx) FILTER (WHERE event_type = 'click')) AS cwd,
  arg_min(CASE a.k % 5 WHEN 0 THEN 'b' || (a.k % 4) ELSE 'f' || (a.k % 4) END, idx) FILTER (WHERE event_type = 'click' AND a.k % 5 IN (0, 2)) AS git_branch,
  arg_min('h' || a.k, idx) FILTER (WHERE event_type = 'click' AND a.k % 5 = 3) AS git_head_sha
FROM act a JOIN first f ON f.session_id = a.session_id GROUP BY a.session_id"""


@_query(_SESSIONS)
def normalized_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First start, last end, last model, workspace and repository, first folder and git fields; a git that is no object hides its line's flat fields."""
    out = normalize.sessions(_records(spark, sf_dir)).filter("problem IS NULL")
    return out.select("file", "transcript_session_id", "started_at", "ended_at", "duration_seconds", "model", "workspace_id", "repo_id", "cwd", "git_branch", "git_head_sha")


@_query("SELECT file, repo_id, cwd, git_branch FROM (" + _SESSIONS + ") WHERE 'b1' IN (repo_id, cwd, git_branch, git_head_sha)")
def sessions_of_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.of_repo(normalized_sessions(spark, sf_dir), "b1").select("file", "repo_id", "cwd", "git_branch")


@_query(_SAID + 'SELECT file, line_no, role, text, "at" FROM talk')
def normalized_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.turns(_records(spark, sf_dir)).select("file", F.col("line_no").cast("long").alias("line_no"), "role", "text", "at")


@_query(_SAID + 'SELECT file, position, call_id, name, input, "at", result, success, result_at, matched FROM calls')
def normalized_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).withColumn("position", F.col("position").cast("long"))


@_query(_SAID + """SELECT file, position, "at", what AS command, success, result AS output FROM calls WHERE lower(name) = 'bash'""")
def normalized_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.commands(_calls(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@_query(_SAID + """SELECT file, position, "at", what AS path, 'edit' AS operation FROM calls WHERE name = 'Edit'""")
def normalized_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.file_changes(_calls(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@_query(_SAID + """SELECT s.file, CASE WHEN hooked THEN 'hook_' || s.file ELSE s.file END AS session_id, CASE WHEN hooked THEN s.file END AS source_transcript_session_id, CASE WHEN hooked THEN last_at END AS event_at,
  coalesce(turns, 0) AS turns, tool_calls, file_changes, commands, tests FROM (
  SELECT file, count(*) AS tool_calls, count(*) FILTER (WHERE name = 'Edit') AS file_changes, count(*) FILTER (WHERE lower(name) = 'bash') AS commands, count(*) FILTER (WHERE lower(name) = 'bash' AND what LIKE '%test%') AS tests FROM calls GROUP BY file) s
JOIN (SELECT session_id AS file, any_value(user_id) % 3 = 0 AS hooked, max("at") AS last_at FROM act GROUP BY session_id) h USING (file) LEFT JOIN (SELECT file, count(*) AS turns FROM talk GROUP BY file) t USING (file)""")
def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sessions; those of every third user were announced by a hook under another id, without a time."""
    rows = A.activity(spark, sf_dir).select("session_id", "user_id").distinct().filter("user_id % 3 = 0")
    hooks = rows.select(F.col("session_id").alias("file"), F.concat(F.lit("hook_"), "session_id").alias("hook_session_id"), F.lit("session_end").alias("event_type"), F.lit(None).cast("string").alias("event_at"))
    whole = normalize.documents(_records(spark, sf_dir), hooks)
    return whole.select("file", "session_id", "source_transcript_session_id", "event_at", *(F.col(c).cast("long").alias(c) for c in ("turns", "tool_calls", "file_changes", "commands", "tests")))


@_query(_SAID + """, records AS (
  SELECT file, ts, 1 AS part, line_no AS place, 0 AS step, 'TextObservation' AS class, CASE role WHEN 'user' THEN 'user' ELSE 'agent' END AS source, text AS content FROM talk
  UNION ALL SELECT file, CASE WHEN matched THEN ts END, 2, position, 0, CASE WHEN lower(name) = 'bash' THEN 'CodeAction' ELSE 'ApiAction' END, CASE WHEN lower(name) = 'bash' THEN 'shell' ELSE name END, CASE WHEN lower(name) = 'bash' THEN what ELSE input END FROM calls
  UNION ALL SELECT file, ts, 2, position, 1, 'TextObservation', 'environment', coalesce(result, '') FROM calls WHERE result IS NOT NULL OR success IS NOT NULL OR result_at IS NOT NULL
) SELECT file, row_number() OVER (PARTITION BY file ORDER BY ts NULLS LAST, part, place, step) AS position, class, source, content FROM records""")
def full_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, calls with their arguments, results and residual commands in order of time; what has no time comes last."""
    records = _records(spark, sf_dir)
    calls = written(normalize.tool_calls(records))
    return export.full_trajectory(normalize.turns(records), calls, normalize.commands(calls)).select("file", F.col("position").cast("long").alias("position"), "class", "source", "content")


# -- what findings rest on ------------------------------------------------------

_LAST = _ACT + """, last_success AS (
  SELECT session_id, "at" AS s_at, command AS s_command FROM verify WHERE success QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, idx DESC) = 1
), last_test AS (
  SELECT session_id, "at" AS t_at, command AS t_command, success AS t_success FROM commands WHERE command LIKE '%test%' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, idx DESC) = 1
), shown AS (
  SELECT f.session_id, seq, row_number() OVER (PARTITION BY f.session_id, seq ORDER BY v.idx) AS fact_no, NULL AS label, 'first_failed_verification_command' AS l1, 'failed_verification_command' AS l2, 'failed_verification_command' AS l3,
    'command' AS kind, v."at", NULL::varchar AS path, NULL::varchar AS operation, v.command, v.success FROM found f JOIN verify v ON v.session_id = f.session_id WHERE type = 'only_failed_verification'
  UNION ALL SELECT f.session_id, seq, 1, 'final_file_change', NULL, NULL, NULL, 'file_change', edit_at, edit_path, 'edit', NULL, NULL FROM found f JOIN edit e ON e.session_id = f.session_id
    WHERE type IN ('final_verification_failed', 'missing_final_verification', 'final_edit_after_last_test', 'broad_file_change')
  UNION ALL SELECT f.session_id, seq, 2, 'last_verification_after_edit', NULL, NULL, NULL, 'command', after_at, NULL, NULL, after_command, after_success FROM found f JOIN after a ON a.session_id = f.session_id WHERE type = 'final_verification_failed'
  UNION ALL SELECT f.session_id, seq, 2, 'last_successful_verification', NULL, NULL, NULL, 'command', s_at, NULL, NULL, s_command, true FROM found f JOIN last_success s ON s.session_id = f.session_id WHERE type IN ('missing_final_verification', 'broad_file_change')
  UNION ALL SELECT f.session_id, seq, 2, 'last_test_command', NULL, NULL, NULL, 'command', t_at, NULL, NULL, t_command, t_success FROM found f JOIN last_test t ON t.session_id = f.session_id WHERE type = 'final_edit_after_last_test'
  UNION ALL SELECT f.session_id, seq, row_number() OVER (PARTITION BY f.session_id, seq ORDER BY c.idx), NULL, 'first_failed_command', 'repeated_failed_command', 'failed_command', 'command', c."at", NULL, NULL, c.command, c.success
    FROM found f JOIN repeated r ON r.session_id = f.session_id AND r.first_idx = f.at_idx JOIN commands c ON c.session_id = f.session_id AND c.command = r.command AND c.success = false WHERE type = 'repeated_failing_command'
  UNION ALL SELECT f.session_id, seq, 1, 'network_command', NULL, NULL, NULL, 'command', c."at", NULL, NULL, c.command, c.success FROM found f JOIN commands c ON c.session_id = f.session_id AND c.idx = f.at_idx WHERE type = 'network_call_without_need'
  UNION ALL SELECT f.session_id, seq, row_number() OVER (PARTITION BY f.session_id, seq ORDER BY c.idx), 'source', NULL, NULL, NULL, 'file_change', c."at", c.path, c.operation, NULL, NULL
    FROM found f JOIN changes c ON c.session_id = f.session_id AND c.path LIKE 'src/%' WHERE type = 'source_changed_without_test_change'
), fact_rows AS (
  SELECT session_id, seq, fact_no, CASE WHEN label = 'source' THEN 'source_file_change_' || fact_no WHEN label IS NOT NULL THEN label WHEN fact_no = 1 THEN l1 WHEN fact_no = 2 THEN l2 ELSE l3 END AS label, kind, "at", path, operation, command, success,
    concat_ws(' | ', "at", CASE WHEN kind = 'command' THEN 'command "' || command || '"' ELSE operation || ' ' || path END, CASE WHEN success THEN 'succeeded' WHEN NOT success THEN 'failed' END) AS line FROM shown
)
"""
_MISSING = """, lacking AS (
  SELECT session_id, 2 AS part, idx AS at_idx, 'commands[' || (row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1) || '].success' AS text, success IS NULL AS lacks FROM commands
), gaps AS (
  SELECT session_id, part, at_idx, text FROM lacking WHERE lacks UNION ALL SELECT session_id, 3, seq, missing FROM found WHERE missing IS NOT NULL
), missing_rows AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY part, at_idx) AS place, text FROM (SELECT * FROM gaps QUALIFY row_number() OVER (PARTITION BY session_id, text ORDER BY part, at_idx) = 1)
)
"""


@_query(_LAST + 'SELECT session_id, seq, fact_no, label, kind, "at", path, operation, command, success, line FROM fact_rows')
def evidence_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.evidence_facts(*_found(spark, sf_dir)).select("session_id", F.col("seq").cast("long").alias("seq"), F.col("fact_no").cast("long").alias("fact_no"), "label", "kind", "at", "path", "operation", "command", "success", "line")


@_query(_ACT + _MISSING + "SELECT session_id, place, text FROM missing_rows")
def missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, commands, _, rows = _found(spark, sf_dir)
    return findings.missing_evidence(changes, commands, rows).withColumn("place", F.col("place").cast("long"))


@_query(_LAST + """, said AS (
  SELECT session_id, seq, 1 AS part, 0 AS fact_no, summary AS line FROM found UNION ALL SELECT session_id, seq, 3, 0, 'missing: ' || missing FROM found WHERE missing IS NOT NULL UNION ALL SELECT session_id, seq, 2, fact_no, line FROM fact_rows
) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, part, fact_no) AS place, line FROM (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY session_id, line ORDER BY seq, part, fact_no) = 1)""")
def review_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence lines of cards that need attention: summaries, facts and what is missing, each line once."""
    changes, commands, facts, rows = _found(spark, sf_dir)
    return findings.card_evidence(rows, findings.evidence_facts(changes, commands, facts, rows)).withColumn("place", F.col("place").cast("long"))


# -- capture, vault and contracts -------------------------------------------------

_NOW = "2024-06-30T00:00:00Z"


@_query(f"""SELECT event_id AS row_id, session_id, CASE WHEN t = '' THEN '{_NOW}' ELSE t END AS timestamp, CASE WHEN t = '' THEN 'capture_time' ELSE 'hook_payload' END AS timestamp_source, kind AS event_type,
  CASE WHEN session_id = '' THEN 'missing required field session_id' WHEN cwd = '' THEN 'missing required field cwd' WHEN k % 9 = 0 THEN 'timestamp must be RFC3339' WHEN kind IS NULL THEN 'unsupported event name ' || name END AS problem,
  'evt_' || substr(sha256('claude_code' || chr(0) || coalesce(kind, '') || chr(0) || session_id || chr(0) || path || chr(0) || cwd || chr(0)), 1, 32) AS event_id FROM (
  SELECT *, CASE name WHEN 'SessionStart' THEN 'session_start' WHEN 'session_start' THEN 'session_start' WHEN 'SessionEnd' THEN 'session_end' WHEN 'session_end' THEN 'session_end' END AS kind FROM (
    SELECT event_id, regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1)::bigint AS k, CASE WHEN user_id % 17 = 0 THEN '' ELSE 's' || user_id END AS session_id, CASE WHEN user_id % 5 = 0 THEN '' ELSE '/t/' || user_id || '.jsonl' END AS path, CASE WHEN user_id % 23 = 0 THEN '' ELSE '/work' END AS cwd,
      CASE event_type WHEN 'purchase' THEN 'SessionEnd' WHEN 'click' THEN 'session_start' WHEN 'view' THEN 'SessionStart' WHEN 'error' THEN 'Stop' ELSE 'session_end' END AS name,
      CASE WHEN regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1)::bigint % 9 = 0 THEN 'yesterday' WHEN event_type = 'view' THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS t FROM events))""")
def hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hook payloads: names of several spellings, some without session, folder or time, some with a bad one."""
    user, kind = F.col("user_id"), F.col("event_type")
    k = F.regexp_extract("props", r'"k":\s*(-?[0-9]+)', 1).cast("long")
    name = F.when(kind == "purchase", "SessionEnd").when(kind == "click", " session_start ").when(kind == "view", "SessionStart").when(kind == "error", "Stop").otherwise("session_end")
    given = F.when(k % 9 == 0, "yesterday").when(kind != "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    path = F.when(user % 5 != 0, F.concat(F.lit("/t/"), user.cast("string"), F.lit(".jsonl")))
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.when(user % 17 != 0, F.concat(F.lit("s"), user.cast("string"))).alias("session_id"), path.alias("transcript_path"), F.when(user % 23 != 0, "/work").otherwise(" ").alias("cwd"), name.alias("hook_event_name"), given.alias("timestamp"))
    return vault.event_records(rows, _NOW).select("row_id", "session_id", "timestamp", "timestamp_source", "event_type", "problem", "event_id")


_ARCHIVED = """WITH archived AS (SELECT *, CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) > 20000 THEN 'failed' WHEN doc_id = min(doc_id) OVER (PARTITION BY CASE WHEN strlen(text) <= 20000 THEN sha256(text) ELSE doc_id::varchar END) THEN 'copied' ELSE 'deduped' END AS outcome, strlen(text) AS size FROM documents)
"""


@_query(_ARCHIVED + """SELECT source, count(*) FILTER (WHERE outcome = 'copied') AS copied, count(*) FILTER (WHERE outcome = 'deduped') AS deduped, count(*) FILTER (WHERE outcome = 'missing') AS missing, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  coalesce(sum(size) FILTER (WHERE outcome = 'deduped'), 0)::bigint AS bytes_saved FROM archived GROUP BY source""")
def archive_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill of all documents; those over 20,000 bytes fail."""
    docs = _table(spark, sf_dir, "documents")
    done = vault.archive(docs, "doc_id", "text", 20_000).join(docs.select(F.col("doc_id").alias("d_id"), "source"), F.col("doc_id") == F.col("d_id"))
    return vault.tallies(done, "source")


@_query(_ARCHIVED + f""", vaults AS (
  SELECT source, count(*) AS captured, count(*) FILTER (WHERE outcome IN ('copied', 'deduped') AND doc_id % 10 < 8) AS archived, count(*) FILTER (WHERE outcome = 'failed') AS copy_failures, count(*) % 2 = 0 AS hook_installed, max(doc_id) % 3 > 0 AS schedule_installed,
    CASE max(doc_id) % 4 WHEN 0 THEN '' WHEN 1 THEN '2024-06-29T10:00:00Z' ELSE '2024-06-0' || (1 + max(doc_id) % 9) || 'T10:00:00Z' END AS last_backfill_at, CASE min(doc_id) % 3 WHEN 0 THEN '' WHEN 1 THEN '2024-06-28T00:00:00Z' ELSE '2024-05-01T00:00:00Z' END AS last_backup_verified_at FROM archived GROUP BY source
), judged AS (
  SELECT *, CASE WHEN last_backfill_at = '' OR try_strptime(last_backfill_at, '%Y-%m-%dT%H:%M:%SZ') < TIMESTAMP '2024-06-23' THEN 'stale' ELSE 'ok' END AS backfill_status,
    CASE WHEN last_backup_verified_at = '' THEN 'missing_or_unverified' WHEN try_strptime(last_backup_verified_at, '%Y-%m-%dT%H:%M:%SZ') < TIMESTAMP '2024-06-23' THEN 'stale' ELSE 'verified' END AS backup_status FROM vaults
) SELECT source, captured, archived, copy_failures, backfill_status, backup_status, CASE WHEN captured >= archived THEN '+' ELSE '' END || (captured - archived) || ' (expected=' || captured || ' archived=' || archived || ')' AS drift,
  concat_ws(chr(10), CASE WHEN NOT hook_installed THEN 'global SessionEnd hook is not installed' END, CASE WHEN NOT schedule_installed THEN 'preservation freshness depends on a schedule that is not installed' END, CASE WHEN backfill_status = 'stale' THEN 'backfill is missing or stale' END,
    CASE backup_status WHEN 'missing_or_unverified' THEN 'backup has never been verified' WHEN 'stale' THEN 'verified backup is stale' END, CASE WHEN copy_failures > 0 THEN 'copy failures recorded: ' || copy_failures END,
    CASE WHEN captured > archived THEN 'transcript drift heuristic indicates captured transcripts without refs' END) AS warnings FROM judged""")
def vault_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault for each source: its documents are the captured transcripts, eight of ten archived ones have refs."""
    docs = _table(spark, sf_dir, "documents")
    done = vault.archive(docs, "doc_id", "text", 20_000).join(docs.select(F.col("doc_id").alias("d_id"), "source"), F.col("doc_id") == F.col("d_id"))
    high, low = F.max("doc_id"), F.min("doc_id")
    day = F.concat(F.lit("2024-06-0"), (1 + high % 9).cast("string"), F.lit("T10:00:00Z"))
    state = done.groupBy("source").agg(
        F.count("*").alias("captured"), F.count_if(F.col("outcome").isin("copied", "deduped") & (F.col("doc_id") % 10 < 8)).alias("archived"), F.count_if(F.col("outcome") == "failed").alias("copy_failures"),
        (F.count("*") % 2 == 0).alias("hook_installed"), (high % 3 > 0).alias("schedule_installed"),
        F.when(high % 4 == 0, "").when(high % 4 == 1, "2024-06-29T10:00:00Z").otherwise(day).alias("last_backfill_at"), F.when(low % 3 == 0, "").when(low % 3 == 1, "2024-06-28T00:00:00Z").otherwise("2024-05-01T00:00:00Z").alias("last_backup_verified_at"),
    )
    checked = vault.doctor(state, F.to_timestamp(F.lit(_NOW)))
    return checked.select("source", "captured", "archived", "copy_failures", "backfill_status", "backup_status", "drift", "warnings")


_TURNS = """WITH turns AS (SELECT conv_id, count(*) AS n, min(turn) FILTER (WHERE role NOT IN ('user', 'assistant')) AS odd, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)
"""


@_query(_TURNS + """SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'unsupported schema_version' WHEN conv_id % 11 = 0 THEN 'missing session_id' WHEN conv_id % 13 = 0 THEN 'unsupported source' WHEN conv_id % 17 = 0 THEN 'missing commands'
  WHEN len(list_filter(roles, lambda r: r NOT IN ('user', 'assistant'))) > 0 THEN 'unsupported turns[' || (list_position(list_transform(roles, lambda r: r NOT IN ('user', 'assistant')), true) - 1) || '].role'
  WHEN conv_id % 3 = 0 THEN 'missing tool_calls[1].name' WHEN conv_id % 5 = 0 THEN 'missing tool_calls[1].input' END AS problem FROM turns""")
def session_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions with planted faults; what is checked first is reported."""
    n = F.col("conv_id")
    per = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x).alias("turns"))
    call = lambda name, given: F.struct(F.lit("c1").alias("tool_call_id"), name.alias("name"), given.alias("input"))
    calls = F.array(call(F.lit("Bash"), F.lit("{}")), call(F.when(n % 3 != 0, "Edit").otherwise(" "), F.when(n % 5 != 0, "{}")))
    none = F.array().cast("array<string>")
    rows = per.withColumns({"schema_version": F.when(n % 7 == 0, "0").otherwise("1"), "session_id": F.when(n % 11 == 0, " ").otherwise(n.cast("string")), "source": F.when(n % 13 == 0, "other").otherwise("recorder"), "tool_calls": calls, "file_changes": none, "commands": F.when(n % 17 != 0, none)})
    return rows.select("conv_id", quality.session_problem("1", "recorder").alias("problem"))


@_query("SELECT session_id, CASE WHEN n_findings % 7 = 3 THEN 'unsupported verdict' WHEN n_findings % 7 = 4 THEN 'missing main_finding' WHEN n_findings % 7 = 5 THEN 'missing evidence' WHEN n_findings % 7 = 6 THEN 'missing warnings' END AS problem FROM (" + _ACT + "SELECT session_id, n_findings FROM cards)")
def card_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review cards with faults planted by their number of findings."""
    n = F.col("n_findings") % 7
    cards = review_cards(spark, sf_dir).withColumns({"schema_version": F.lit("1"), "verdict": F.when(n == 3, "maybe").otherwise(F.col("verdict")), "main_finding": F.when(n == 4, " ").otherwise(F.col("main_finding")), "evidence": F.when(n != 5, F.col("evidence")), "warnings": F.when(n != 6, F.array())})
    return cards.select("session_id", quality.card_problem("1").alias("problem"))


@_query(_ACT + "SELECT session_id, seq, CASE seq % 5 WHEN 0 THEN 'missing finding_id' WHEN 1 THEN 'unsupported type' WHEN 2 THEN 'missing title' WHEN 3 THEN 'missing summary' END AS problem FROM found")
def finding_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with faults planted by their place."""
    _, _, _, rows = _found(spark, sf_dir)
    n = F.col("seq") % 5
    broken = rows.withColumns({"finding_id": F.when(n != 0, F.format_string("%s.%04d", "type", "seq")), "title": F.when(n != 2, "a title"), "type": F.when(n == 1, "unheard_of").otherwise(F.col("type")), "summary": F.when(n == 3, " ").otherwise(F.col("summary"))})
    return broken.select("session_id", F.col("seq").cast("long").alias("seq"), quality.finding_problem(list(findings.TYPES)).alias("problem"))


_SCHEMA = {
    "type": "object", "required": ["id", "turns", "owner"], "additionalProperties": False,
    "properties": {"id": {"type": "integer"}, "kind": {"const": "talk"}, "owner": {"type": ["string", "null"]}, "turns": {"type": "array", "items": {"type": "object", "required": ["text"], "properties": {"role": {"enum": ["user", "assistant"]}, "n": {"type": "integer"}}}}},
}


@_query("""WITH t AS (SELECT conv_id, turn, role, text FROM conversations), per AS (
  SELECT conv_id, list(CASE WHEN role NOT IN ('user', 'assistant') THEN '$.turns[].role: enum' END ORDER BY turn) AS a, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS odd, count(*) FILTER (WHERE turn % 4 = 3) AS halves FROM t GROUP BY conv_id)
SELECT conv_id, odd + halves + (conv_id % 5 = 0)::int + (conv_id % 6 = 0)::int + (conv_id % 4 = 0)::int + (conv_id % 9 = 0)::int AS n_violations, odd AS n_enum, halves + (conv_id % 5 = 0)::int AS n_type, (conv_id % 6 = 0)::int::bigint AS n_const, (conv_id % 4 = 0)::int::bigint AS n_required, (conv_id % 9 = 0)::int::bigint AS n_additional FROM per""")
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested documents against a schema: constants, enums, types, required and additional keys, items."""
    n = F.col("conv_id")
    turn = F.struct("turn", F.struct("role", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") + F.when(F.col("turn") % 4 == 3, 0.5).otherwise(0.0)).alias("n")).alias("t"))
    per = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]).alias("turns"))
    fields = {"kind": F.when(n % 6 == 0, "walk").otherwise("talk"), "owner": F.when(n % 4 != 0, "me"), "more": F.when(n % 9 == 0, 1), "turns": F.col("turns")}
    doc = F.when(n % 5 == 0, F.to_json(F.struct(F.lit("five").alias("id"), *(c.alias(k) for k, c in fields.items())))).otherwise(F.to_json(F.struct((n * 1.0).alias("id"), *(c.alias(k) for k, c in fields.items()))))
    found = written(per.select("conv_id", quality.schema_violations(F.parse_json(doc), _SCHEMA).alias("v")))
    rule = lambda name: F.size(F.filter("v", lambda x: x.endswith(": " + name))).cast("long").alias(f"n_{name}")
    return found.select("conv_id", F.size("v").cast("long").alias("n_violations"), *(rule(x) for x in ("enum", "type", "const", "required", "additional")))


@_query(f"""SELECT page_id, path, CASE WHEN path LIKE '%/.claude/%' THEN 'claude_code' WHEN path LIKE '%/.codex/%' THEN 'codex' ELSE 'manual' END AS source, CASE WHEN path LIKE '%/subagents/%' THEN 'subagent_transcript' ELSE 'main_transcript' END AS kind,
  regexp_matches(name, '^[A-Za-z0-9_.-]+$') AND name NOT IN ('.', '..') AS safe_id, regexp_matches(sha, '^[0-9a-f]{{64}}$') AS hex_digest, './' || name AS href,
  seen = '' OR try_strptime(seen, '%Y-%m-%dT%H:%M:%SZ') < TIMESTAMP '2024-06-23' AS stale FROM (
  SELECT page_id, '/home/u' || CASE page_id % 3 WHEN 0 THEN '/.claude/' WHEN 1 THEN '/.codex/' ELSE '/' END || CASE WHEN page_id % 4 = 0 THEN 'subagents/' ELSE '' END || name AS path, name, CASE WHEN page_id % 2 = 0 THEN sha256(name) ELSE upper(sha256(name)) END AS sha,
    CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '2024-06-29T00:00:00Z' ELSE '2024-06-01T00:00:00Z' END AS seen FROM (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '..' WHEN 1 THEN 'a b' ELSE 'p-' || page_id || '.jsonl' END AS name FROM pages))""")
def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of page ids: recorder, kind, safe names, digests, links, staleness."""
    n = F.col("page_id")
    name = F.when(n % 7 == 0, "..").when(n % 7 == 1, "a b").otherwise(F.concat(F.lit("p-"), n.cast("string"), F.lit(".jsonl")))
    path = F.concat(F.lit("/home/u"), F.when(n % 3 == 0, "/.claude/").when(n % 3 == 1, "/.codex/").otherwise("/"), F.when(n % 4 == 0, "subagents/").otherwise(""), name)
    sha = F.when(n % 2 == 0, F.sha2(name, 256)).otherwise(F.upper(F.sha2(name, 256)))
    seen = F.when(n % 5 == 0, "").when(n % 5 == 1, "2024-06-29T00:00:00Z").otherwise("2024-06-01T00:00:00Z")
    return _table(spark, sf_dir, "pages").select("page_id", path.alias("path"), vault.source_of(path).alias("source"), vault.kind_of(path).alias("kind"), C.is_safe_id(name).alias("safe_id"), C.is_hex_digest(sha).alias("hex_digest"), text.local_href(name).alias("href"), stale(seen, F.to_timestamp(F.lit(_NOW))).alias("stale"))


@_query("""SELECT conv_id, list_aggregate(list_distinct_in_order, 'string_agg', ',') AS roles FROM (
  SELECT conv_id, list(role ORDER BY first) AS list_distinct_in_order FROM (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE trim(role) <> '' GROUP BY conv_id, role) GROUP BY conv_id)""")
def roles_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation by first appearance."""
    per = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit(" "), x["role"], F.lit(" "))).alias("r"))
    return per.select("conv_id", F.array_join(text.distinct_nonblank(F.col("r")), ",").alias("roles"))


@_query(_ARCHIVED + """SELECT CASE outcome WHEN 'missing' THEN 'raw_missing' WHEN 'failed' THEN 'copy_failed' ELSE 'processed' END AS reason, count(*) AS n FROM archived GROUP BY 1""")
def drain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed and skipped contents by reason."""
    done = vault.archive(_table(spark, sf_dir, "documents"), "doc_id", "text", 20_000)
    return done.groupBy(F.coalesce(vault.skip_reason(F.col("outcome")), F.lit("processed")).alias("reason")).agg(F.count("*").alias("n"))


@_query(_ACT + """SELECT session_id, '"' || replace(replace(replace(replace(path, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(1), chr(92) || 'x01'), chr(9), chr(92) || 't') || '"' AS quoted FROM (
  SELECT session_id, idx, path || CASE idx % 4 WHEN 0 THEN '"' WHEN 1 THEN chr(92) WHEN 2 THEN chr(9) ELSE chr(1) END AS path FROM changes)""")
def quoted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed paths with an odd character behind them, quoted."""
    odd = F.when(F.col("idx") % 4 == 0, '"').when(F.col("idx") % 4 == 1, "\\").when(F.col("idx") % 4 == 2, "\t").otherwise("\x01")
    return A.changes(A.activity(spark, sf_dir)).select("session_id", text.quoted(F.concat("path", odd)).alias("quoted"))
