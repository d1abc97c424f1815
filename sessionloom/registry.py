"""The refinery's queries over the given tables, by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import redaction, text
from .functions.diff import line_diff
from .operators import matching
from .plans import activity as A
from .plans import export, findings, quality, report, vault
from .sources.tables import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import registry_refinery, registry_sessions  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import registry_refinery, registry_sessions  # noqa: F401

    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_cards(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = written(A.activity(spark, sf_dir))
    return A.changes(rows), A.commands(rows)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.session_facts(*_both(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Changes, commands, facts and finding rows; the events are read once."""
    changes, commands = _both(spark, sf_dir)
    facts = written(findings.session_facts(changes, commands))
    return changes, commands, facts, written(findings.finding_rows(changes, commands, facts))


# -- SQL shared by the oracles ------------------------------------------------

_ACT = """
WITH act AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS idx, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "at" FROM (
    SELECT event_id, user_id, event_type, ts, user_id || '_' || floor(date_diff('day', DATE '2024-01-01', ts::date) / 7)::bigint AS session_id,
      regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1)::bigint AS k FROM events)
), changes AS (
  SELECT session_id, idx, ts, "at", 'edit' AS operation,
    CASE k % 4 WHEN 0 THEN 'src/f' || k || '.go' WHEN 1 THEN 'tests/f' || k || '_test.py' WHEN 2 THEN 'docs/f' || k || '.md' ELSE 'go.mod' END AS path
  FROM act WHERE event_type = 'click'
), commands AS (
  SELECT session_id, idx, ts, "at",
    CASE event_type WHEN 'error' THEN 'make build t' || (k % 5) WHEN 'purchase' THEN 'make verify t' || (k % 5) WHEN 'signup' THEN 'go test ./p' || k ELSE 'curl u' || k END AS command,
    CASE event_type WHEN 'error' THEN false WHEN 'signup' THEN CASE WHEN k % 10 <> 0 THEN false END ELSE true END AS success
  FROM act WHERE event_type <> 'click'
), verify AS (
  SELECT * FROM commands WHERE command LIKE '%test%' OR command LIKE 'make build%' OR command LIKE 'make verify%'
), edit AS (
  SELECT session_id, ts AS edit_ts, "at" AS edit_at, path AS edit_path FROM changes QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, idx DESC) = 1
), after AS (
  SELECT v.session_id, v."at" AS after_at, v.command AS after_command, v.success AS after_success
  FROM verify v JOIN edit e ON v.session_id = e.session_id AND v.ts > e.edit_ts
  QUALIFY row_number() OVER (PARTITION BY v.session_id ORDER BY v.ts DESC, v.idx DESC) = 1
), per_command AS (
  SELECT session_id, count(*) AS commands_run, count(*) FILTER (WHERE command LIKE '%test%') AS tests_run,
    max(ts) FILTER (WHERE command LIKE '%test%') AS test_ts, max("at") FILTER (WHERE command LIKE '%test%') AS test_at,
    count(*) FILTER (WHERE command LIKE 'curl%') AS networks
  FROM commands GROUP BY session_id
), per_verify AS (
  SELECT session_id, count(*) AS verifications, count(*) FILTER (WHERE success IS NOT DISTINCT FROM false) AS failures,
    max(ts) FILTER (WHERE success) AS success_ts, max("at") FILTER (WHERE success) AS success_at FROM verify GROUP BY session_id
), per_change AS (
  SELECT session_id, count(*) AS files_changed, count(*) FILTER (WHERE path = 'go.mod') AS manifests,
    count(*) FILTER (WHERE path LIKE 'src/%') AS source_changes, count(*) FILTER (WHERE path LIKE 'tests/%') AS test_files FROM changes GROUP BY session_id
), facts AS (
  SELECT s.session_id, coalesce(commands_run, 0) AS commands_run, coalesce(tests_run, 0) AS tests_run, test_ts, test_at, coalesce(networks, 0) AS networks,
    coalesce(verifications, 0) AS verifications, coalesce(failures, 0) AS failures, success_ts, success_at,
    coalesce(files_changed, 0) AS files_changed, coalesce(manifests, 0) AS manifests, coalesce(source_changes, 0) AS source_changes, coalesce(test_files, 0) AS test_files,
    edit_ts, edit_at, edit_path, after_at, after_command, after_success,
    coalesce(verifications, 0) > 0 AND coalesce(verifications, 0) = coalesce(failures, 0) AS only_failed,
    coalesce(after_success = false, false) AS final_failed
  FROM (SELECT DISTINCT session_id FROM act) s LEFT JOIN per_command USING (session_id) LEFT JOIN per_verify USING (session_id)
  LEFT JOIN per_change USING (session_id) LEFT JOIN edit USING (session_id) LEFT JOIN after USING (session_id)
), repeated AS (
  SELECT session_id, command, count(*) AS failures, min(idx) AS first_idx FROM commands WHERE success = false GROUP BY session_id, command HAVING count(*) >= 2
), found AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank, at_idx) AS seq FROM (
    SELECT session_id, 1 AS rank, 0 AS at_idx, 'only_failed_verification' AS type, verifications || ' verification command(s) ran in this session and none succeeded.' AS summary, 'successful verification command at any point in this session' AS missing FROM facts WHERE only_failed
    UNION ALL SELECT session_id, 2, 0, 'final_verification_failed', 'The last verification command "' || after_command || '" after the final file change at ' || edit_at || ' failed at ' || after_at || '.', 'successful verification command after ' || after_at FROM facts WHERE final_failed
    UNION ALL SELECT session_id, 4, 0, 'missing_final_verification', 'No successful verification command ran after the final file change at ' || edit_at || '.', 'successful verification command after ' || edit_at FROM facts WHERE edit_ts IS NOT NULL AND NOT coalesce(success_ts > edit_ts, false)
    UNION ALL SELECT session_id, 5, 0, 'final_edit_after_last_test', edit_path || ' changed via edit at ' || edit_at || ' after the last test command at ' || test_at || '.', NULL FROM facts WHERE edit_ts > test_ts
    UNION ALL SELECT session_id, 6, 0, 'broad_file_change', files_changed || ' files changed in this session and no successful verification command covered the result.', 'successful verification command covering this broad change' FROM facts WHERE files_changed >= 8 AND (success_ts IS NULL OR only_failed OR final_failed)
    UNION ALL SELECT session_id, 7, first_idx, 'repeated_failing_command', '"' || command || '" failed ' || failures || ' times in this session.', NULL FROM repeated
    UNION ALL SELECT c.session_id, 8, idx, 'network_call_without_need', 'Network or install command "' || command || '" ran at ' || "at" || ' with no package or dependency file change in this session.', NULL FROM commands c JOIN facts f ON f.session_id = c.session_id WHERE command LIKE 'curl%' AND manifests = 0
    UNION ALL SELECT session_id, 9, 0, 'source_changed_without_test_change', source_changes || ' source file change(s) recorded in this session, but no test files changed.', 'test file change in the same session' FROM facts WHERE source_changes > 0 AND test_files = 0)
), cards AS (
  SELECT f.session_id, CASE WHEN n IS NULL THEN 'clean' ELSE 'needs_attention' END AS verdict,
    coalesce(main, 'No evidence findings were detected in this session.') AS main_finding, main_type, coalesce(n, 0) AS n_findings
  FROM facts f LEFT JOIN (SELECT session_id, count(*) AS n, arg_min(summary, seq) AS main, arg_min(type, seq) AS main_type FROM found GROUP BY session_id) USING (session_id)
)
"""
_SPAN = """, spans AS (SELECT session_id, min("at") AS started_at, max("at") AS ended_at, date_diff('microsecond', min(ts), max(ts)) // 1000000 AS duration_seconds, count(*) AS n_events FROM act GROUP BY session_id)
"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activity(spark, sf_dir).groupBy("session_id").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("duration_seconds"), F.count("*").alias("n_events"))


# -- sessions and evidence ----------------------------------------------------


@_query(_ACT + _SPAN + "SELECT session_id, started_at, ended_at, duration_seconds, n_events, files_changed, commands_run, tests_run FROM facts JOIN spans USING (session_id)")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir).select("session_id", "files_changed", "commands_run", "tests_run")
    return _spans(spark, sf_dir).join(facts, "session_id")


@_query("SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'user' ELSE 'agent' END AS source, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant')")
def turns_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.turns(spark, sf_dir)


@_query("""SELECT conv_id, count(*) AS n_records, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS agent_turns,
  count(*) FILTER (WHERE role IS NULL OR role NOT IN ('user', 'assistant')) AS ignored, min(turn) AS first_turn, max(turn) AS last_turn,
  arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def conversation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    known = F.coalesce(role.isin("user", "assistant"), F.lit(False))
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_records"), F.count_if(role == "user").alias("user_turns"), F.count_if(role == "assistant").alias("agent_turns"), F.count_if(~known).alias("ignored"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"),
    )


@_query(_ACT + "SELECT session_id, after_at AS \"at\", after_command AS command, after_success AS success FROM after")
def last_verification_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.last_verification_after_edit(*_both(spark, sf_dir)).select("session_id", "at", "command", "success")


def _flag(name: str, flag: str, columns: list[str], sql_flag: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _facts(spark, sf_dir).filter(flag).select("session_id", *columns)

    run.__name__ = name
    _query(_ACT + f"SELECT session_id, {', '.join(columns)} FROM facts WHERE {sql_flag}")(run)


_flag("only_failed_verification", "only_failed", ["verifications"], "only_failed")
_flag("final_verification_failed", "final_failed", ["after_at", "after_command"], "final_failed")
_flag("missing_final_verification", "missing_final", ["edit_at", "success_at"], "edit_ts IS NOT NULL AND NOT coalesce(success_ts > edit_ts, false)")
_flag("final_edit_after_last_test", "edit_after_test", ["edit_at", "test_at", "edit_path"], "edit_ts > test_ts")
_flag("broad_change_sessions", "broad", ["files_changed"], "files_changed >= 8 AND (success_ts IS NULL OR only_failed OR final_failed)")
_flag("network_without_manifest", "needless_network", ["commands_run"], "networks > 0 AND manifests = 0")
_flag("source_without_test", "untested_source", ["source_changes"], "source_changes > 0 AND test_files = 0")


@_query(_ACT + "SELECT * FROM repeated")
def repeated_failing_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.repeated_failures(_both(spark, sf_dir)[1])


@_query(_ACT.replace("'make build t' || (k % 5)", "CASE WHEN k % 25 = 0 THEN 'rm -rf build t' ELSE 'make build t' END || (k % 5)") + "SELECT session_id, idx, \"at\", command FROM commands WHERE command LIKE 'rm -rf%'")
def destructive_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed builds whose number 25 divides delete their target instead."""
    rows = A.activity(spark, sf_dir)
    wiped = F.when((F.col("event_type") == "error") & (F.col("k") % 25 == 0), F.concat(F.lit("rm -rf build t"), (F.col("k") % 5).cast("string")))
    named = A.commands(rows).join(rows.select(F.col("session_id").alias("s"), F.col("idx").alias("i"), wiped.alias("wiped")), (F.col("session_id") == F.col("s")) & (F.col("idx") == F.col("i")))
    return named.withColumn("command", F.coalesce("wiped", "command")).filter(findings.C.is_destructive(F.col("command"))).select("session_id", "idx", "at", "command")


_SEVERITY = "CASE WHEN type IN ('only_failed_verification', 'final_verification_failed', 'missing_final_verification') THEN 'high' ELSE 'medium' END"
_CONFIDENCE = "CASE WHEN type IN ('broad_file_change', 'network_call_without_need', 'source_changed_without_test_change') THEN 'medium' ELSE 'high' END"


@_query(_ACT + f"SELECT session_id, seq, printf('%s.%04d', type, seq) AS finding_id, type, {_SEVERITY} AS severity, {_CONFIDENCE} AS confidence, summary, missing FROM found")
def findings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, commands = _both(spark, sf_dir)
    return findings.findings(changes, commands, written(findings.session_facts(changes, commands)))


@_query(_ACT + f"SELECT type, {_SEVERITY} AS severity, count(*) AS n_findings, count(DISTINCT session_id) AS n_sessions FROM found GROUP BY ALL")
def finding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_long(spark, sf_dir).groupBy("type", "severity").agg(F.count("*").alias("n_findings"), F.count_distinct("session_id").alias("n_sessions"))


def _habits(i: int) -> str:
    return "CASE main_type " + " ".join("WHEN '{}' THEN '{}'".format(k, v[i].replace("'", "''")) for k, v in findings.TYPES.items()) + " END"


@_query(_ACT + f"""SELECT c.session_id, verdict, main_finding, coalesce({_habits(2)}, 'Keep ending sessions with a visible verification command.') AS suggested_next_habit, {_habits(3)} AS suggested_skill, n_findings,
  CASE WHEN verdict = 'clean' THEN concat_ws(chr(10), 'files_changed: ' || files_changed, 'commands_run: ' || commands_run, 'tests_run: ' || tests_run, 'final_file_edit_at: ' || edit_at,
    'last_test_command_at: ' || test_at, 'last_successful_verification_at: ' || success_at, 'verification_after_final_edit: ' || (success_ts >= edit_ts)) ELSE lines END AS evidence
FROM cards c JOIN facts f ON f.session_id = c.session_id LEFT JOIN (
  SELECT session_id, string_agg(line, chr(10) ORDER BY seq, part) AS lines FROM (
    SELECT session_id, seq, part, line FROM (SELECT session_id, seq, 1 AS part, summary AS line FROM found UNION ALL SELECT session_id, seq, 2, 'missing: ' || missing FROM found WHERE missing IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY session_id, line ORDER BY seq, part) = 1) GROUP BY session_id) l ON l.session_id = c.session_id""")
def review_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, commands = _both(spark, sf_dir)
    facts = written(findings.session_facts(changes, commands))
    return findings.review_cards(facts, findings.findings(changes, commands, facts))


@_query(_ACT + "SELECT session_id, string_agg(summary, chr(10) ORDER BY seq) AS top_findings, count(*) AS n_shown FROM found WHERE seq <= 5 GROUP BY session_id")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = findings_long(spark, sf_dir).filter("seq <= 5").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "summary"))).alias("s"))
    return per.select("session_id", F.array_join(F.transform("s", lambda x: x["summary"]), "\n").alias("top_findings"), F.size("s").cast("long").alias("n_shown"))


@_query(_ACT + _SPAN + "SELECT session_id, started_at, ended_at, verdict, n_findings FROM spans JOIN cards USING (session_id) ORDER BY ended_at DESC, session_id LIMIT 20")
def latest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = session_list_view(spark, sf_dir).select("session_id", "started_at", "ended_at", "verdict", "n_findings")
    return listed.orderBy(F.desc("ended_at"), "session_id").limit(20)


@_query(_ACT + _SPAN + "SELECT session_id, started_at, ended_at, verdict, n_findings, main_finding FROM spans JOIN cards USING (session_id)")
def session_list_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).join(review_cards(spark, sf_dir), "session_id").select("session_id", "started_at", "ended_at", "verdict", "n_findings", "main_finding")


@_query(_ACT + _SPAN + "SELECT f.session_id, duration_seconds, files_changed, commands_run, tests_run, verifications, edit_at, success_at, verdict FROM facts f JOIN spans USING (session_id) JOIN cards USING (session_id)")
def session_detail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir).select("session_id", "files_changed", "commands_run", "tests_run", "verifications", "edit_at", "success_at")
    return facts.join(_spans(spark, sf_dir).select("session_id", "duration_seconds"), "session_id").join(review_cards(spark, sf_dir).select("session_id", "verdict"), "session_id")


@_query(_ACT + "SELECT session_id, 'sessions/' || session_id || '/review.json' AS path, 'sha256:' || sha256(session_id || '|' || verdict || '|' || main_finding) AS digest FROM cards")
def artifact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws("|", "session_id", "verdict", "main_finding")
    return review_cards(spark, sf_dir).select("session_id", F.concat(F.lit("sessions/"), "session_id", F.lit("/review.json")).alias("path"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("digest"))


@_query(_ACT + _SPAN + "SELECT session_id, ended_at, ended_at < strftime((SELECT max(ts) FROM act) - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S.%fZ') AS stale FROM spans")
def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that ended more than seven days before the newest event."""
    rows = A.activity(spark, sf_dir)
    newest = rows.agg(F.max("ts").alias("newest"))
    ends = rows.groupBy("session_id").agg(F.max("at").alias("ended_at"), F.max("ts").alias("end_ts"))
    return ends.crossJoin(F.broadcast(newest)).select("session_id", "ended_at", (F.col("end_ts") < F.col("newest") - F.expr("INTERVAL 7 DAYS")).alias("stale"))  # one row broadcast


@_query("""SELECT session_id, count(DISTINCT event_type) AS n_present, CASE WHEN count(DISTINCT event_type) = 5 THEN 'skip' WHEN count(DISTINCT event_type) = 1 THEN 'process' ELSE 'error' END AS state
FROM (SELECT event_type, user_id || '_' || floor(date_diff('day', DATE '2024-01-01', ts::date) / 7)::bigint AS session_id FROM events) GROUP BY session_id""")
def artifact_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five event types as the expected artifacts: all there, only one, or some."""
    n = F.count_distinct("event_type")
    return A.activity(spark, sf_dir).groupBy("session_id").agg(n.alias("n_present"), F.when(n == 5, "skip").when(n == 1, "process").otherwise("error").alias("state"))


_CARD = ORACLES["review_cards"]


def _escaped(c: str) -> str:
    quotes = (("'", "&#39;"), ('"', "&#34;"))
    for plain, escaped in quotes:
        c = "replace({}, '{}', '{}')".format(c, plain.replace("'", "''"), escaped)
    return c


@_query(f"""SELECT session_id, sha256('<!doctype html><title>' || session_id || '</title><table>' || t || '</table><ul>' || array_to_string(list_transform(string_split(ev, chr(10)), lambda e: '<li>' || e || '</li>'), '') || '</ul>') AS page_sha256 FROM (
  SELECT session_id, '<tr><th>Verdict</th><td>' || verdict || '</td></tr><tr><th>Main finding</th><td>' || {_escaped("main_finding")} || '</td></tr><tr><th>Next habit</th><td>' || {_escaped("suggested_next_habit")}
    || '</td></tr><tr><th>Skill</th><td>' || coalesce(suggested_skill, 'not recorded') || '</td></tr>' AS t, {_escaped("evidence")} AS ev FROM ({_CARD}))""")
def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pages(review_cards(spark, sf_dir)).select("session_id", F.sha2("page", 256).alias("page_sha256"))


# -- matching and export --------------------------------------------------------


@_query(_ACT + """, records AS (
  SELECT session_id, ts, idx * 2 AS seq, 'api_action' AS class, operation || ' ' || path AS content FROM changes
  UNION ALL SELECT session_id, ts, idx * 2, 'code_action', command FROM commands
  UNION ALL SELECT session_id, ts, idx * 2 + 1, 'text_observation', CASE WHEN success THEN 'success' ELSE 'failure' END FROM commands WHERE success IS NOT NULL
) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS LAST, seq) AS position, seq, class, content FROM records""")
def trajectory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.trajectory(export.activity_records(*_both(spark, sf_dir))).select("session_id", "position", "seq", "class", "content")


@_query("""SELECT session_id, '{"id":"' || session_id || '","content":[' || string_agg('{"class_":"' || class || '","content":"' || content || '"}', ',' ORDER BY position) || '],"details":{"version":"1.1.0","data_class":"corpus"}}' AS line
FROM (""" + ORACLES["trajectory_order"] + ") GROUP BY session_id")
def trajectory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.json_lines(export.trajectory(export.activity_records(*_both(spark, sf_dir))))


@_query(_ACT + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, command ORDER BY idx) AS n FROM commands)
SELECT r.session_id, r.idx, r.command FROM ranked r LEFT JOIN (SELECT session_id, command, count(*) AS have FROM commands WHERE success GROUP BY ALL) h ON h.session_id = r.session_id AND h.command = r.command
WHERE r.n > coalesce(have, 0)""")
def residual_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands beyond as many as succeeded with the same text."""
    commands = _both(spark, sf_dir)[1].select("session_id", "idx", "command", "success")
    return matching.multiset_minus(commands, commands.filter("success"), ["session_id", "command"], ["idx"]).select("session_id", "idx", "command")


@_query("""WITH rows AS (
  SELECT event_id, user_id, ts, event_type = 'click' AS is_use FROM events WHERE event_type IN ('click', 'purchase')
), a AS (SELECT *, sum(CASE WHEN is_use THEN 1 ELSE -1 END) OVER w AS balance, sum(is_use::int) OVER w AS uses, sum((NOT is_use)::int) OVER w AS results FROM rows WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), b AS (SELECT *, greatest(0, -min(balance) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS lost FROM a
), c AS (SELECT *, coalesce(lag(lost) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS lost_before FROM b)
SELECT event_id, user_id, is_use, (CASE WHEN is_use THEN uses WHEN lost = lost_before THEN results - lost END)::bigint AS pair FROM c""")
def tool_result_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as results of the user's oldest open click."""
    rows = _table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "ts", (F.col("event_type") == "click").alias("is_use"))
    return matching.pair_first_in_first_out(rows, ["user_id"], ["ts", "event_id"], "is_use").select("event_id", "user_id", "is_use", "pair")


@_query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' OR source = 'src3'")
def session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").filter((F.col("lang") == "fr") | (F.col("source") == "src3")).select("doc_id", "lang", "source")


# -- vault ---------------------------------------------------------------------


@_query("""SELECT event_id, base_id, CASE WHEN n = 1 THEN base_id ELSE base_id || '_' || n END AS stored_id FROM (
  SELECT event_id, base_id, row_number() OVER (PARTITION BY base_id ORDER BY event_id) AS n FROM (
    SELECT event_id, 'evt_' || substr(sha256(user_id || chr(0) || event_type || chr(0) || strftime(ts, '%Y-%m-%d') || chr(0)), 1, 32) AS base_id FROM events))""")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by user, type and day, so that some collide."""
    base = vault.event_id(F.col("user_id"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd"))
    rows = _table(spark, sf_dir, "events").select("event_id", base.alias("base_id"))
    return matching.collision_suffix(rows, "base_id", ["event_id"], "stored_id")


@_query("""SELECT doc_id, digest, size, 'blobs/' || substr(digest, 1, 2) || '/' || digest AS path, CASE WHEN digest IS NULL THEN 'missing' WHEN n = 1 THEN 'copied' ELSE 'deduped' END AS outcome FROM (
  SELECT doc_id, sha256(text) AS digest, strlen(text) AS size, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents)""")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.archive(_table(spark, sf_dir, "documents"), "doc_id", "text")


_BLOBS = """WITH blobs AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL),
refs AS (SELECT digest FROM blobs JOIN labels USING (doc_id) WHERE quality = 1), tombs AS (SELECT digest FROM blobs JOIN labels USING (doc_id) WHERE toxic = 1) """


def _blobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All texts' digests; those of good documents as refs; those of toxic ones as tombstones."""
    blobs = _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    labelled = blobs.join(_table(spark, sf_dir, "labels"), "doc_id")
    return blobs, labelled.filter("quality = 1").select("digest"), labelled.filter("toxic = 1").select("digest")


@_query(_BLOBS + "SELECT DISTINCT digest, CASE WHEN digest IN (SELECT digest FROM tombs) THEN 'tombstoned' WHEN digest IN (SELECT digest FROM refs) THEN 'referenced' ELSE 'orphan' END AS state FROM blobs")
def orphan_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.classify_blobs(*_blobs(spark, sf_dir))


@_query(_BLOBS + "SELECT doc_id, digest FROM blobs WHERE digest NOT IN (SELECT digest FROM tombs)")
def tombstoned_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs, _, tombs = _blobs(spark, sf_dir)
    return vault.without_tombstoned(blobs, tombs).select("doc_id", "digest")


@_query(_BLOBS + "SELECT (SELECT count(*) FROM blobs) AS captured, (SELECT count(DISTINCT digest) FROM blobs) AS n_blobs, (SELECT count(*) FROM refs) AS n_refs, (SELECT count(*) FROM blobs) - (SELECT count(*) FROM refs) AS drift")
def vault_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs, refs, _ = _blobs(spark, sf_dir)
    have = blobs.agg(F.count("*").alias("captured"), F.count_distinct("digest").alias("n_blobs"))
    return have.crossJoin(F.broadcast(refs.agg(F.count("*").alias("n_refs")))).withColumn("drift", F.col("captured") - F.col("n_refs"))  # one row each


@_query("""WITH live AS (SELECT conv_id || '/' || turn AS path, sha256(text) AS digest FROM conversations), backup AS (SELECT conv_id || '/' || turn AS path, sha256(trim(text, ' .')) AS digest FROM conversations WHERE role <> 'system')
SELECT coalesce(l.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'extra' WHEN l.digest = b.digest THEN 'ok' ELSE 'changed' END AS state FROM live l FULL JOIN backup b ON l.path = b.path""")
def backup_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup that lacks system turns and has lost the full stops at ends."""
    talk = _table(spark, sf_dir, "conversations").withColumn("path", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    live = talk.select("path", F.sha2("text", 256).alias("digest"))
    return vault.compare_backup(live, talk.filter("role <> 'system'").select("path", F.sha2(F.expr("trim(BOTH ' .' FROM text)"), 256).alias("digest")))


# -- redaction and text -----------------------------------------------------------

# The passes' patterns as DuckDB writes them.
_HIT_SQL = {
    "private_key": r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
    "credential_url": r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"''<>@:/]+:[^\s"''<>@]+@[^\s"''<>]+""",
    "jwt": r"\b[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,}\b",
    "api_key": r"\b(?:sk-[A-Za-z0-9][A-Za-z0-9_-]{20,}|(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{20,})\b",
    "ssh_remote": r"\bgit@[A-Za-z0-9._-]+:[A-Za-z0-9._~/%+-]+(?:\.git)?\b",
    "assignment": r"""(?i)\b((?:[A-Z0-9_]*(?:API[_-]?KEY|ACCESS[_-]?TOKEN|AUTH[_-]?TOKEN|TOKEN|SECRET|PASSWORD|PASSWD|JWT)[A-Z0-9_]*)\s*(?:[:=]\s*)+(?:>\s*)?)([^\s"'',;]+)""",
    "space_value": r"""(?i)\b((?:API[_-]?KEY|ACCESS[_-]?TOKEN|AUTH[_-]?TOKEN|TOKEN|PASSWORD|PASSWD|JWT)\s+)([^\s"'',;]+)""",
    "high_entropy": r"\b[A-Za-z0-9+/=_-]{32,}\b",
    "posix_path": r"/(?:Users|home|tmp|private|var|opt|Volumes)(?:/[A-Za-z0-9._@%+=:,~-]+)+",
    "secret_path": r"(?:~|\.)/[A-Za-z0-9._@%+=:,\-/]*(?:\.env|credentials?|secrets?|secret|token|key)[A-Za-z0-9._@%+=:,\-/]*",
    "windows_path": r"""[A-Za-z]:\\(?:Users|Temp|tmp|Windows|ProgramData)(?:\\[^\s"''<>|;]+)+""",
}


def _hits(spark: SparkSession, sf_dir: str, table: str, id_col: str, body: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("pattern"), redaction.hits(F.col(body), n).cast("long").alias("hits")) for n in redaction.PATTERN))
    return _table(spark, sf_dir, table).select(id_col, F.explode(each).alias("h")).select(id_col, "h.pattern", "h.hits").filter("hits > 0")


def _hits_sql(table: str, id_col: str, body: str) -> str:
    return " UNION ALL ".join(f"SELECT {id_col}, '{n}' AS pattern, len(regexp_extract_all({body}, '{p}'))::bigint AS hits FROM {table} WHERE regexp_matches({body}, '{p}')" for n, p in _HIT_SQL.items())


@_query(_hits_sql("documents", "doc_id", "text"))
def redaction_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "documents", "doc_id", "text")


@_query(_hits_sql("pages", "page_id", "html"))
def page_redaction_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "pages", "page_id", "html")


@_query()
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redaction.redact(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "redacted")
    return done.select("doc_id", F.size(F.regexp_extract_all("redacted", F.lit(redaction.MARK), F.lit(0))).alias("n_placeholders"), F.sha2("redacted", 256).alias("redacted_sha256"))


def _redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sessions whose fields are their lines, redacted and numbered over the document."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return redaction.numbered(written(redaction.redact(lines, "text", "redacted", "events")), "doc_id", ["line"], "redacted", "events", "shown")


@_query()
def redaction_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders numbered over each document's lines, for the lines that have any."""
    found = _redacted_lines(spark, sf_dir).filter(F.col("shown").contains("[REDACTED_"))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), F.sha2("shown", 256).alias("shown_sha256"))


@_query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_HIT_SQL["high_entropy"]}')) AS token FROM documents),
chars AS (SELECT DISTINCT token, unnest(string_split(token, '')) AS c, len(token) AS n FROM t), counted AS (
  SELECT token, c, n, (n - len(replace(token, c, '')))::double / n AS p FROM chars WHERE c <> ''),
e AS (SELECT token, round(sum(-p * log2(p)), 6) AS entropy FROM counted GROUP BY token)
SELECT doc_id, t.token, entropy, (regexp_matches(t.token, '[a-z]')::int + regexp_matches(t.token, '[A-Z]')::int + regexp_matches(t.token, '[0-9]')::int + regexp_matches(t.token, '[+/=_-]')::int) AS classes FROM t JOIN e ON e.token = t.token""")
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = redaction.PATTERN["high_entropy"]
    tokens = _table(spark, sf_dir, "documents").filter(F.col("text").rlike(pattern)).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("token"))
    return tokens.select("doc_id", "token", F.round(text.entropy(F.col("token")), 6).alias("entropy"), text.character_classes(F.col("token")).alias("classes"))


@_query(r"""SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE substr(t, 1, 157) || '...' END AS excerpt FROM (
  SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^SPACE+|SPACE+$', '', 'g') AS t FROM documents)""".replace("SPACE", text.SPACE_SQL))
def text_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@_query(f"SELECT conv_id, turn, trim(regexp_replace(text, '{text.SPACE_SQL}+', ' ', 'g')) AS command FROM conversations")
def command_text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.collapse_space(F.col("text")).alias("command"))


@_query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;')) AS escaped_sha256 FROM pages""")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(text.html_escape(F.col("html")), 256).alias("escaped_sha256"))


@_query("""SELECT event_id, json_valid(props) AS valid_json, json_valid(props) AND json_extract(props, '$.k') IS NULL AS missing_key,
  coalesce(json_valid(props) AND json_type(props, '$.k') NOT IN ('BIGINT', 'UBIGINT'), false) AS wrong_type, json_valid(props) AND len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0 AS extra_key FROM events""")
def json_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality.check_document(_table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": "integer"})
    return checked.select("event_id", "valid_json", "missing_key", "wrong_type", "extra_key")


@_query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@_query("""SELECT dimension, blocking, failures, CASE WHEN failures = 0 THEN 'green' WHEN blocking THEN 'red' ELSE 'amber' END AS state FROM (
  SELECT 'D01' AS dimension, true AS blocking, (SELECT count(*) FROM documents d JOIN benchmark b ON contains(d.text, b.text)) AS failures
  UNION ALL SELECT 'D02', true, (SELECT count(*) FROM events WHERE NOT json_valid(props) OR json_type(props, '$.k') NOT IN ('BIGINT', 'UBIGINT'))
  UNION ALL SELECT 'D03', false, (SELECT count(*) - count(DISTINCT text) FROM documents))""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed checks: benchmark passages in documents, broken event contracts, repeated contents."""
    bad = json_contract_check(spark, sf_dir).filter("NOT valid_json OR missing_key OR wrong_type")
    n = F.count("*").alias("failures")
    repeats = (F.count("*") - F.count_distinct(F.sha2("text", 256))).alias("failures")
    checks = [("D01", True, leak_scan(spark, sf_dir).agg(n)), ("D02", True, bad.agg(n)), ("D03", False, _table(spark, sf_dir, "documents").agg(repeats))]
    rows = [df.select(F.lit(d).alias("dimension"), F.lit(b).alias("blocking"), "failures") for d, b, df in checks]
    return quality.scorecard(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@_query()
def redaction_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per line and kind, with the document's placeholders."""
    return redaction.summary(_redacted_lines(spark, sf_dir), "doc_id", ["line"], "shown")


@_query()
def redacted_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested tool inputs, every string redacted in its place."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.struct(F.split("text", "\n").alias("lines")).alias("args"), F.lit("run").alias("name"), F.lit(1).alias("n"))).alias("input"))
    done = redaction.redact_json(docs, ["doc_id"], "input", "shown").filter(F.col("shown") != F.col("input"))
    return done.select("doc_id", F.size(F.regexp_extract_all("shown", F.lit(redaction.MARK), F.lit(0))).cast("long").alias("n_placeholders"), F.sha2("shown", 256).alias("shown_sha256"))


@_query()
def redacted_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as metadata: a value that no pass touches is a secret as a whole."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return redaction.redact_metadata(pages, "url", "shown").select("page_id", "shown")


@_query()
def turn_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as lines against the turn of the same role before it."""
    lined = F.regexp_replace("text", r"\. ", ".\n")
    talk = _table(spark, sf_dir, "conversations").withColumn("lined", lined)
    before = F.lag("lined").over(W.partitionBy("conv_id", "role").orderBy("turn"))
    return talk.withColumn("before", before).filter("before IS NOT NULL").select("conv_id", "turn", line_diff("before", "lined").alias("diff"))


@_query("""WITH p AS (SELECT conv_id % 9 AS fault, conv_id::varchar AS session_id, 'talk/' || min(turn) || '.jsonl' AS transcript_path FROM conversations GROUP BY conv_id)
SELECT session_id, CASE fault WHEN 8 THEN 'session_start' ELSE 'SessionEnd' END AS event_name, CASE WHEN fault IN (1, 2) THEN '' ELSE transcript_path END AS transcript_path, '/w/' || session_id AS cwd, fault IN (1, 2) AS raw_missing, NULL AS problem FROM p WHERE fault NOT BETWEEN 3 AND 7
UNION ALL SELECT CASE fault WHEN 3 THEN '' ELSE session_id END, NULL, NULL, NULL, NULL,
  CASE fault WHEN 3 THEN 'missing required field session_id' WHEN 4 THEN 'missing required field cwd' WHEN 5 THEN 'missing required field hook_event_name' WHEN 6 THEN 'timestamp must be RFC3339' ELSE 'unsupported event name Stop' END FROM p WHERE fault BETWEEN 3 AND 7""")
def spool_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as hook payloads in a spool, some with a gap, drained by a stream and read back, the refused ones with their problem."""
    from .streaming.drain import drain_spool

    base = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    fault = F.col("conv_id") % 9
    path = F.concat(F.lit("talk/"), F.col("first").cast("string"), F.lit(".jsonl"))
    sid = F.col("conv_id").cast("string")
    fields = {
        "session_id": F.when(fault == 3, "  ").otherwise(sid), "transcript_path": F.when(fault == 1, " ").when(fault != 2, path), "cwd": F.when(fault != 4, F.concat(F.lit("/w/"), sid)),
        "hook_event_name": F.when(fault == 7, "Stop").when(fault == 8, "session_start").when(fault != 5, "SessionEnd"), "timestamp": F.when(fault == 6, "yesterday").when(fault == 0, "2024-05-01T10:00:00Z"),
    }
    talk = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"))
    talk.select(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("value")).write.text(f"{base}/in")
    drain_spool(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", line_payloads=True)
    good = spark.read.parquet(f"{base}/out").select("session_id", "event_name", "transcript_path", "cwd", "raw_missing", F.lit(None).cast("string").alias("problem"))
    return good.unionByName(spark.read.parquet(f"{base}/out_quarantine").select("session_id", "problem"), allowMissingColumns=True)
