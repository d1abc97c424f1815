"""A page per session from its review card, as a string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to, html_escape, local_href


def _row(label: str, value: Column) -> Column:
    shown = html_escape(blank_to(F.coalesce(value.cast("string"), F.lit("")), "not recorded"))
    return F.concat(F.lit(f"<tr><th>{label}</th><td>"), shown, F.lit("</td></tr>"))


def pages(cards: DataFrame) -> DataFrame:
    """(session_id, page): verdict, finding, habit and skill in a table, evidence lines as a list."""
    items = F.array_join(F.transform(F.split("evidence", "\n"), lambda x: F.concat(F.lit("<li>"), html_escape(x), F.lit("</li>"))), "")
    table = F.concat(_row("Verdict", F.col("verdict")), _row("Main finding", F.col("main_finding")), _row("Next habit", F.col("suggested_next_habit")), _row("Skill", F.col("suggested_skill")))
    page = F.concat(F.lit("<!doctype html><title>"), html_escape(F.col("session_id")), F.lit("</title><table>"), table, F.lit("</table><ul>"), items, F.lit("</ul>"))
    return cards.select("session_id", page.alias("page"))


def _said(tag: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), html_escape(F.coalesce(value.cast("string"), F.lit(""))), F.lit(f"</{tag}>"))


def _list(array: Column, none: str) -> Column:
    items = F.array_join(F.transform(array, lambda x: _said("li", x)), "")
    return F.when(F.size(array) == 0, F.lit(f"<p>{none}</p>")).otherwise(F.concat(F.lit("<ul>"), items, F.lit("</ul>")))


def _table(*rows: Column) -> Column:
    return F.concat(F.lit("<table>"), *rows, F.lit("</table>"))


def _section(name: str, title: str, *parts: Column) -> Column:
    return F.concat(F.lit(f'<section id="{name}"><h2>{title}</h2>'), *parts, F.lit("</section>"))


def _fact(x: Column) -> Column:
    """One fact that a finding rests on."""
    fields = {"Label": "label", "Kind": "kind", "Timestamp": "timestamp", "Path": "path", "Operation": "operation", "Command": "command"}
    outcome = F.when(x["success"].isNotNull(), _row("Success", x["success"])).otherwise(F.lit(""))
    return F.concat(F.lit("<li>"), _said("p", x["display"]), _table(*(_row(k, x[c]) for k, c in fields.items()), outcome), F.lit("</li>"))


def _finding(x: Column) -> Column:
    fields = {"Finding ID": "finding_id", "Type": "type", "Severity": "severity", "Confidence": "confidence", "Summary": "summary"}
    facts = F.concat(F.lit("<ol>"), F.array_join(F.transform(x["evidence"], _fact), ""), F.lit("</ol>"))
    shown = F.when(F.size(x["evidence"]) == 0, F.lit("<p>No evidence facts recorded.</p>")).otherwise(facts)
    lacks = _list(x["missing_evidence"], "No missing evidence recorded for this finding.")
    return F.concat(F.lit("<article>"), _said("h3", x["title"]), _table(*(_row(k, x[c]) for k, c in fields.items())), F.lit("<h4>Evidence</h4>"), shown, F.lit("<h4>Missing evidence for this finding</h4>"), lacks, F.lit("</article>"))


def _redaction_row(x: Column) -> Column:
    cells = (x["id"], x["type"], x["field"], x["replacement_count"], F.array_join(x["placeholders"], ", "))
    return F.concat(F.lit("<tr>"), *(_said("td", c) for c in cells), F.lit("</tr>"))


def document(artifacts: dict[str, tuple]) -> Column:
    """A session's whole report: summary, card, findings with their facts, what is missing, redaction, artifacts, digests.

    Of a row that has a redacted session's columns, its card's (evidence and
    warnings as arrays), ``findings`` (array), the counts of its facts and
    ``digests`` (artifact to digest). Nothing of the raw transcript is shown.
    """
    path = {a: F.concat(F.lit("sessions/"), "session_id", F.lit("/" + v[0])) for a, v in artifacts.items()}
    digest = lambda a: F.element_at("digests", F.lit(a))
    there = lambda a: F.lit(True) if a == "html_report" else digest(a).isNotNull()
    summary = {
        "Session ID": F.col("session_id"), "Source": F.col("source"), "Agent model": F.col("agent_model"), "Input session artifact": path["normalized_session"], "Status": F.col("pipeline_status"), "Duration seconds": F.coalesce("duration_seconds", F.lit(0)),
        "Source transcript session ID": F.col("source_transcript_session_id"), "Workspace ID": F.col("workspace_id"), "Repo ID": F.col("repo_id"), "CWD": F.col("cwd"), "Turns": F.size("turns"), "Tool calls": F.size("tool_calls"),
        "Files changed": F.col("files_changed"), "Commands run": F.col("commands_run"), "Tests run": F.col("tests_run"),
    }
    found = F.when(F.size("findings") == 0, F.lit("<p>No evidence findings recorded.</p>")).otherwise(F.array_join(F.transform("findings", _finding), ""))
    redactions = F.when(F.size("redaction.findings") == 0, F.lit("<p>No redaction findings recorded.</p>")).otherwise(
        F.concat(F.lit("<table><tr><th>ID</th><th>Type</th><th>Field</th><th>Replacements</th><th>Placeholders</th></tr>"), F.array_join(F.transform("redaction.findings", _redaction_row), ""), F.lit("</table>"))
    )
    link = lambda a: F.concat(F.lit('<td><a href="'), html_escape(local_href(path[a])), F.lit('">'), html_escape(path[a]), F.lit("</a></td>"))
    listed = [F.concat(F.lit(f"<tr><td>{label}</td><td>{media}</td>"), link(a), F.when(there(a), "<td>available</td></tr>").otherwise("<td>not generated</td></tr>")) for a, (_, media, label, linked, _) in artifacts.items() if linked]
    digests = [F.when(digest(a).isNotNull(), F.concat(F.lit(f"<tr><td>{label}</td>"), _said("td", path[a]), _said("td", digest(a)), F.lit("</tr>"))).otherwise("") for a, (_, _, label, _, _) in artifacts.items()]
    return F.concat(
        F.lit('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Session report '), html_escape(F.col("session_id")), F.lit("</title></head><body><main>"),
        _section("session-summary", "Session summary", _table(*(_row(k, c) for k, c in summary.items()))),
        _section("review-card", "Review card", _table(_row("Verdict", F.col("verdict")), _row("Main finding", F.col("main_finding")), _row("Suggested next habit", F.col("suggested_next_habit")), _row("Suggested skill", F.col("suggested_skill"))),
                 F.lit("<h3>Review evidence</h3>"), _list(F.col("evidence"), "No review evidence recorded."), F.lit("<h3>Warnings</h3>"), _list(F.col("warnings"), "No warnings recorded.")),
        _section("evidence-findings", "Evidence findings", found),
        _section("missing-evidence", "Missing evidence", _list(F.col("warnings"), "No missing evidence recorded.")),
        _section("redaction-summary", "Redaction summary", _table(_row("Status", F.col("redaction.status")), _row("Secret placeholders", F.col("redaction.secret_placeholders")), _row("Path placeholders", F.col("redaction.path_placeholders"))), F.lit("<h3>Redaction findings</h3>"), redactions),
        _section("artifacts", "Artifacts", F.lit("<table><tr><th>Artifact</th><th>Media type</th><th>Path</th><th>Status</th></tr>"), *listed, F.lit("</table>")),
        _section("provenance-digests", "Provenance digests", F.lit("<table><tr><th>Artifact</th><th>Path</th><th>Digest</th></tr>"), *digests, F.lit("</table>")),
        F.lit("</main></body></html>\n"),
    )
