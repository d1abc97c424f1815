"""The six artifacts of a session: as recorded, redacted, evidence, review card, report, export.

Everything but the first is made of redacted sessions. Bodies are JSON texts
(a page, a JSON line), with the digest of their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeparse import lenient, seconds_between
from ..sources.tables import written
from . import export, findings, report
from .redacted import not_redacted, redact_sessions

# Artifact -> (file, media type, label, whether others link to it, whether it must be there).
ARTIFACTS = {
    "normalized_session": ("normalized.json", "application/json", "Normalized session", False, True),
    "redacted_session": ("redacted.json", "application/json", "Redacted session", True, True),
    "evidence_bundle": ("evidence.json", "application/json", "Evidence bundle", True, True),
    "review_card": ("review.json", "application/json", "Review card", True, True),
    "html_report": ("report.html", "text/html", "HTML report", True, False),
    "export_line": ("session.export.jsonl", "application/jsonl", "Strict export", True, False),
}
# Titles of findings.
TITLES = {
    "only_failed_verification": "Verification never succeeded in this session",
    "final_verification_failed": "Final verification command failed",
    "destructive_command": "Destructive shell command ran",
    "missing_final_verification": "Final verification is missing",
    "final_edit_after_last_test": "Final edit happened after the last test",
    "broad_file_change": "Broad multi-file change without successful verification",
    "repeated_failing_command": "Command failed repeatedly",
    "network_call_without_need": "Network or install command ran without a package task",
    "source_changed_without_test_change": "Source changed without test change",
}
EVIDENCE_VERSION, CARD_VERSION = "evidence.v1", "review_card.v1"
#: Status of a session whose stored form is the redacted one.
IMPORTED = "imported"


def path_of(artifact: str) -> Column:
    return F.concat(F.lit("sessions/"), "session_id", F.lit("/" + ARTIFACTS[artifact][0]))


def changes_of(sessions: DataFrame) -> DataFrame:
    rows = sessions.select("session_id", F.posexplode("file_changes").alias("idx", "r"))
    return rows.select("session_id", F.col("idx").cast("long").alias("idx"), lenient(F.col("r.timestamp")).alias("ts"), F.col("r.timestamp").alias("at"), "r.path", "r.operation")


def commands_of(sessions: DataFrame) -> DataFrame:
    rows = sessions.select("session_id", F.posexplode("commands").alias("idx", "r"))
    return rows.select("session_id", F.col("idx").cast("long").alias("idx"), lenient(F.col("r.timestamp")).alias("ts"), F.col("r.timestamp").alias("at"), "r.command", "r.success", "r.output")


class Evidence:
    """What the rules find in redacted sessions, each table written once: changes, commands, facts (a row for every session), rows, shown, missing."""

    def __init__(self, redacted: DataFrame) -> None:
        self.changes, self.commands = written(changes_of(redacted)), written(commands_of(redacted))
        facts = redacted.select("session_id").join(findings.session_facts(self.changes, self.commands), "session_id", "left")
        empty = {f.name: 0 if f.dataType.simpleString() in ("bigint", "int") else False for f in facts.schema if f.dataType.simpleString() in ("bigint", "int", "boolean") and f.name not in ("test_success", "after_success")}
        self.facts = written(facts.fillna(empty))
        self.rows = written(findings.finding_rows(self.changes, self.commands, self.facts))
        self.shown = written(findings.evidence_facts(self.changes, self.commands, self.facts, self.rows))
        self.missing = written(findings.missing_evidence(self.changes, self.commands, self.rows))

    def cards(self) -> DataFrame:
        """Review cards with all lines of evidence (array) and ``warnings`` (array): what the session lacks."""
        look = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in findings.TYPES.items() for x in (k, v[i]))), F.col("type"))
        found = self.rows.select("session_id", "seq", F.format_string("%s.%04d", F.col("type"), F.col("seq")).alias("finding_id"), "type", look(0).alias("severity"), look(1).alias("confidence"), "summary", "missing")
        cards = findings.review_cards(self.facts, found)
        lines = findings.card_evidence(self.rows, self.shown).groupBy(F.col("session_id").alias("l_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
        warned = self.missing.groupBy(F.col("session_id").alias("w_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("warnings"))
        both = cards.join(lines, F.col("session_id") == F.col("l_id"), "left").join(warned, F.col("session_id") == F.col("w_id"), "left")
        none = F.array().cast("array<string>")
        return both.withColumns({"evidence": F.coalesce("lines", F.split("evidence", "\n")), "warnings": F.coalesce("warnings", none)}).drop("lines", "l_id", "w_id")

    def found(self) -> DataFrame:
        """(session_id, findings): each session's findings with their facts and what they lack, as an array in order; sessions without any have no row."""
        fact = F.struct("fact_no", F.struct("label", "kind", F.col("at").alias("timestamp"), "path", "operation", "command", "success", F.col("line").alias("display")).alias("r"))
        facts = self.shown.groupBy(F.col("session_id").alias("s_id"), F.col("seq").alias("s_seq")).agg(F.transform(F.array_sort(F.collect_list(fact)), lambda x: x["r"]).alias("facts"))
        look = lambda values, c="type": F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(c))
        rows = self.rows.join(facts, (F.col("session_id") == F.col("s_id")) & (F.col("seq") == F.col("s_seq")), "left")
        missing = F.when(F.col("missing").isNull(), F.array().cast("array<string>")).otherwise(F.array("missing"))
        row = F.struct(
            F.format_string("%s.%04d", F.col("type"), F.col("seq")).alias("finding_id"), "type", look(TITLES).alias("title"), look({k: v[0] for k, v in findings.TYPES.items()}).alias("severity"), look({k: v[1] for k, v in findings.TYPES.items()}).alias("confidence"),
            "summary", F.coalesce("facts", F.array().cast(facts.schema["facts"].dataType.simpleString())).alias("evidence"), missing.alias("missing_evidence"),
        )
        return rows.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("r")))), lambda x: x["r"]).alias("findings"))


def _session_json(redaction: bool) -> Column:
    nested = lambda c: F.try_parse_json(c)
    fields = [
        "schema_version", "data_class", "pipeline_status", "session_id", "source", "agent_model", "workspace_id", "repo_id", "transcript_path", "source_transcript_session_id", F.struct("cwd").alias("workspace"), "started_at", "ended_at", "source_event_id",
        F.struct(F.col("git_remote").alias("remote"), F.col("git_branch").alias("branch"), F.col("git_head_sha").alias("head_sha")).alias("git"), "turns", F.transform("tool_calls", lambda x: x.withField("input", nested(x["input"]))).alias("tool_calls"), "file_changes", "commands", nested(F.col("provenance")).alias("provenance"),
    ]
    return F.to_json(F.struct(*fields, *(["redaction"] if redaction else [])))


def export_lines(redacted: DataFrame) -> DataFrame:
    """(session_id, line): whole redacted sessions as one JSON line each."""
    place = lambda df, array: df.select(F.col("session_id").alias("file"), F.posexplode(array).alias("i", "r"))
    turns = place(redacted, "turns").select("file", F.col("i").alias("line_no"), "r.role", F.col("r.content").alias("text"), F.col("r.timestamp").alias("at"))
    calls = place(redacted, "tool_calls").select("file", (F.col("i") + 1).alias("position"), "r.name", "r.input", F.col("r.timestamp").alias("at"), "r.result", "r.success", F.col("r.result_timestamp").alias("result_at"))
    commands = place(redacted, "commands").select("file", (F.col("i") + 1).alias("position"), F.col("r.timestamp").alias("at"), "r.command", "r.success", "r.output")
    ordered = export.full_trajectory(turns, calls, commands)
    said, shell = F.col("class") == "TextObservation", F.col("class") == "CodeAction"
    fields = {"class_": F.col("class"), "source": F.when(said, F.col("source")), "content": F.when(said, F.col("content")), "function": F.when(~said & ~shell, F.col("source")), "kwargs": F.when(~said & ~shell, F.try_parse_json("content")), "language": F.when(shell, F.col("source")), "code": F.when(shell, F.col("content"))}
    record = F.struct("position", F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("r"))
    per = ordered.groupBy(F.col("file").alias("e_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]), ",").alias("records"))
    head = F.concat(F.lit('{"schema_version":"1.1.0","data_class":"corpus","id":'), F.expr("substring(to_json(array(session_id)), 2, length(to_json(array(session_id))) - 2)"), F.lit(',"content":['))
    whole = redacted.select("session_id", "source").join(per, F.col("session_id") == F.col("e_id"), "left")
    return whole.select("session_id", F.concat(head, F.coalesce("records", F.lit("")), F.lit('],"details":'), F.to_json(F.struct("source")), F.lit("}")).alias("line"))


def artifacts(sessions: DataFrame, imported: bool = False) -> tuple[DataFrame, DataFrame]:
    """((session_id, artifact, path, body, digest), refused sessions with ``problem``).

    ``sessions`` are rows of ``normalize.session_rows``. With ``imported`` the
    session is stored redacted, with that status and without the summary.
    """
    redacted, refused = redact_sessions(sessions)
    redacted = written(redacted.filter(not_redacted(redacted).isNull()))
    raw = sessions.join(redacted.select("session_id"), "session_id", "left_semi").withColumns({"data_class": F.lit("raw"), "pipeline_status": F.lit("normalized")})
    stored = redacted.withColumn("pipeline_status", F.lit(IMPORTED)) if imported else raw
    found = Evidence(redacted)
    cards, bundles = written(found.cards()), written(found.found())
    facts = found.facts.select(F.col("session_id").alias("f_id"), "files_changed", "commands_run", "tests_run", "edit_at", "test_at", "success_at")
    summary = F.struct(F.lit("complete").alias("status"), "source", "files_changed", "commands_run", "tests_run", F.col("edit_at").alias("final_file_edit_at"), F.col("test_at").alias("last_test_command_at"), F.col("success_at").alias("last_successful_verification_at"))
    none = F.array().cast(bundles.schema["findings"].dataType.simpleString())
    whole = redacted.join(cards.withColumnRenamed("session_id", "c_id"), F.col("session_id") == F.col("c_id")).join(facts, F.col("session_id") == F.col("f_id")).join(bundles.withColumnRenamed("session_id", "b_id"), F.col("session_id") == F.col("b_id"), "left")
    whole = whole.withColumns({"findings": F.coalesce("findings", none), "duration_seconds": seconds_between(lenient(F.col("started_at")), lenient(F.col("ended_at")))})
    evidence = F.to_json(F.struct(F.lit(EVIDENCE_VERSION).alias("schema_version"), F.lit("redacted").alias("data_class"), "session_id", "source_event_id", summary.alias("summary"), "findings", F.col("warnings").alias("missing_evidence")))
    card = F.to_json(F.struct(F.lit(CARD_VERSION).alias("schema_version"), F.lit("review").alias("data_class"), "session_id", "verdict", "main_finding", "evidence", "suggested_next_habit", "suggested_skill", "warnings"))
    parts = written(
        stored.select("session_id", F.lit("normalized_session").alias("artifact"), _session_json(False).alias("body"))
        .unionByName(whole.select("session_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("redacted_session", "evidence_bundle", "review_card"))), F.array(_session_json(True), evidence, card))).alias("artifact", "body")))
        .unionByName(export_lines(redacted).select("session_id", F.lit("export_line").alias("artifact"), F.col("line").alias("body")))
    )
    digest = F.concat(F.lit("sha256:"), F.sha2("body", 256))
    digests = parts.groupBy(F.col("session_id").alias("d_id")).agg(F.map_from_entries(F.collect_list(F.struct("artifact", digest))).alias("digests"))
    pages = whole.join(digests, F.col("session_id") == F.col("d_id")).select("session_id", F.lit("html_report").alias("artifact"), report.document(ARTIFACTS).alias("body"))
    path = F.concat(F.lit("sessions/"), "session_id", F.lit("/"), F.element_at(F.create_map(*(F.lit(x) for k, v in ARTIFACTS.items() for x in (k, v[0]))), F.col("artifact")))
    return parts.unionByName(pages).select("session_id", "artifact", path.alias("path"), "body", digest.alias("digest")), refused


def completeness(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """(session_id, state, missing) of each expected session: ``skip`` if all six artifacts are there, ``process`` if none is, else ``error`` with the missing files, comma-joined in the artifacts' order."""
    have = existing.groupBy(F.col("session_id").alias("h_id")).agg(F.collect_set("artifact").alias("have"))
    df = expected.select("session_id").distinct().join(have, F.col("session_id") == F.col("h_id"), "left")
    have_ = F.coalesce("have", F.array().cast("array<string>"))
    files = F.array_compact(F.array(*(F.when(~F.array_contains(have_, a), F.lit(v[0])) for a, v in ARTIFACTS.items())))
    n = F.size(files)
    return df.select("session_id", F.when(n == 0, "skip").when(n == len(ARTIFACTS), "process").otherwise("error").alias("state"), F.when((n > 0) & (n < len(ARTIFACTS)), F.array_join(files, ",")).otherwise("").alias("missing"))


def imported_sessions(bodies: DataFrame) -> DataFrame:
    """(session_id, ended_at, verdict, position) of sessions stored with the status of an import that have a review card and evidence; latest end first, else start, ties by path."""
    body = lambda artifact, *fields: bodies.filter(F.col("artifact") == artifact).select(F.col("session_id").alias(f"{artifact}_id"), *(F.get_json_object("body", f"$.{f}").alias(f) for f in fields))
    stored = body("normalized_session", "pipeline_status", "started_at", "ended_at").filter(F.trim("pipeline_status") == IMPORTED)
    both = stored.join(body("review_card", "verdict"), F.col("normalized_session_id") == F.col("review_card_id")).join(body("evidence_bundle"), F.col("normalized_session_id") == F.col("evidence_bundle_id"), "left_semi")
    latest = F.coalesce(F.nullif(F.trim("ended_at"), F.lit("")), F.trim("started_at"))
    return both.select(F.col("normalized_session_id").alias("session_id"), latest.alias("latest_at"), "verdict")
