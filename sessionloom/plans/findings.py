"""Evidence findings of sessions: one aggregate per session, one branch per rule.

``changes`` has session_id, idx, ts, at, path, operation; ``commands`` has
session_id, idx, ts, at, command, success (null: unknown). ``ts`` is a
timestamp or null, ``at`` the time's original string. Sessions should be
redacted before, as rules judge what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import commands as C
from ..functions.text import collapse_space, quoted
from ..operators.matching import last_after

#: Changes from which a session is broad.
BROAD = 8
# Type -> (severity, confidence, habit, skill).
_LOOP = "After the last edit, run the project's verification command and keep the result in the session."
TYPES = {
    "only_failed_verification": ("high", "high", _LOOP, "final-verification-loop"),
    "final_verification_failed": ("high", "high", _LOOP, "final-verification-loop"),
    "destructive_command": ("high", "high", "Before running destructive shell commands, confirm exactly what they will delete and avoid running them inside an unrelated task.", "destructive-command-guard"),
    "missing_final_verification": ("high", "high", _LOOP, "final-verification-loop"),
    "final_edit_after_last_test": ("medium", "high", _LOOP, "final-verification-loop"),
    "broad_file_change": ("medium", "medium", "Before making broad multi-file changes, run a fast verification command and capture its result.", "broad-change-verification-loop"),
    "repeated_failing_command": ("medium", "high", "When a command fails twice, change the code or command before running it again.", "debug-failing-command-loop"),
    "network_call_without_need": ("medium", "medium", "Avoid network or install commands unless the task explicitly adds or upgrades a dependency.", "network-call-guard"),
    "source_changed_without_test_change": ("medium", "medium", "When you change a source file, add or update a test in the same session.", "source-with-test-loop"),
}
RANK = {name: i + 1 for i, name in enumerate(TYPES)}


def last_change(changes: DataFrame) -> DataFrame:
    """Per session the latest timed change, later index among equals."""
    row = F.max_by(F.struct("ts", "at", "path", "operation"), F.struct("ts", "idx"))
    best = changes.filter("ts IS NOT NULL").groupBy("session_id").agg(row.alias("r"))
    return best.select("session_id", *(F.col(f"r.{c}").alias(f"edit_{c}") for c in ("ts", "at", "path", "operation")))


def last_verification_after_edit(changes: DataFrame, commands: DataFrame) -> DataFrame:
    """Per session the last verification strictly after the last edit, whatever its outcome."""
    verify = commands.filter(C.is_verification(F.col("command"))).select("session_id", "ts", "idx", "at", "command", "success")
    return last_after(verify, last_change(changes), "session_id", "ts", "edit_ts", "idx")


def session_facts(changes: DataFrame, commands: DataFrame) -> DataFrame:
    """One row per session of either input: everything that the rules compare."""
    cmd, path = F.col("command"), F.col("path")
    verify, success = C.is_verification(cmd), F.coalesce(F.col("success"), F.lit(False))
    order = F.struct("ts", "idx")

    def last(cond: Column, what: str) -> Column:
        return F.max_by(what, F.when(cond & F.col("ts").isNotNull(), order))

    per_command = commands.groupBy("session_id").agg(
        F.count("*").alias("commands_run"),
        F.count_if(C.is_test(cmd)).alias("tests_run"),
        F.count_if(verify).alias("verifications"),
        F.bool_and(F.when(verify, F.coalesce(~F.col("success"), F.lit(False)))).alias("all_failed"),
        last(C.is_test(cmd), "ts").alias("test_ts"),
        last(C.is_test(cmd), "at").alias("test_at"),
        last(C.is_test(cmd), "command").alias("test_command"),
        last(C.is_test(cmd), "success").alias("test_success"),
        last(verify & success, "ts").alias("success_ts"),
        last(verify & success, "at").alias("success_at"),
        last(verify & success, "command").alias("success_command"),
        F.bool_or(C.is_network(cmd)).alias("has_network"),
    )
    per_change = changes.groupBy("session_id").agg(
        F.count("*").alias("files_changed"),
        F.bool_or(C.is_manifest(path)).alias("has_manifest"),
        F.bool_or(C.is_source_file(path)).alias("has_source"),
        F.bool_or(C.is_test_file(path)).alias("has_test_file"),
        F.count_if(C.is_source_file(path)).alias("source_changes"),
    )
    after = last_verification_after_edit(changes, commands)
    after = after.select("session_id", F.col("at").alias("after_at"), F.col("command").alias("after_command"), F.col("success").alias("after_success"))
    facts = per_command.join(per_change, "session_id", "full").join(last_change(changes), "session_id", "left").join(after, "session_id", "left")
    zero = {c: 0 for c in ("commands_run", "tests_run", "verifications", "files_changed", "source_changes")}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("all_failed", "has_network", "has_manifest", "has_source", "has_test_file")}
    facts = facts.fillna(zero).withColumns(flags)
    only_failed = (F.col("verifications") > 0) & F.col("all_failed")
    final_failed = F.coalesce(F.col("after_success") == F.lit(False), F.lit(False))
    has_edit = F.col("edit_ts").isNotNull()
    return facts.withColumns(
        {
            "only_failed": only_failed,
            "final_failed": final_failed,
            "missing_final": has_edit & ~F.coalesce(F.col("success_ts") > F.col("edit_ts"), F.lit(False)),
            "edit_after_test": F.coalesce(F.col("edit_ts") > F.col("test_ts"), F.lit(False)),
            "broad": has_edit & (F.col("files_changed") >= BROAD) & (F.col("success_ts").isNull() | only_failed | final_failed),
            "needless_network": F.col("has_network") & ~F.col("has_manifest"),
            "untested_source": F.col("has_source") & ~F.col("has_test_file"),
        }
    )


def repeated_failures(commands: DataFrame) -> DataFrame:
    """Commands that failed twice or more in a session, equal up to white space."""
    failed = commands.filter("success = false").withColumn("command", collapse_space(F.col("command"))).filter("command <> ''")
    return failed.groupBy("session_id", "command").agg(F.count("*").alias("failures"), F.min("idx").alias("first_idx")).filter("failures >= 2")


def finding_rows(changes: DataFrame, commands: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings in order: session_id, seq, rank, at_idx (of the command it is about), type, summary, missing (null if none), repeated (the command, white space collapsed)."""
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    edit_at = F.col("edit_at")

    def rule(kind: str, on: str | Column, summary: Column, missing: Column | None = None) -> Column:
        row = F.struct(F.lit(RANK[kind]).alias("rank"), F.lit(0).cast("long").alias("at_idx"), F.lit(kind).alias("type"), summary.alias("summary"), (missing if missing is not None else F.lit(None).cast("string")).alias("missing"), F.lit(None).cast("string").alias("repeated"))
        return F.when(F.col(on) if isinstance(on, str) else on, row)

    # The sentences.
    once = F.array_compact(F.array(
        rule("only_failed_verification", "only_failed", text(F.col("verifications").cast("string"), " verification command(s) ran in this session and none succeeded."), F.lit("successful verification command at any point in this session")),
        rule("final_verification_failed", "final_failed", text("The last verification command ", quoted(collapse_space(F.col("after_command"))), " after the final file change at ", edit_at, " failed at ", F.col("after_at"), "."), text("successful verification command after ", F.col("after_at"))),
        rule("missing_final_verification", "missing_final", text("No successful verification command ran after the final file change at ", edit_at, "."), text("successful verification command after ", edit_at)),
        rule("final_edit_after_last_test", "edit_after_test", text(F.col("edit_path"), " changed via ", F.col("edit_operation"), " at ", edit_at, " after the last test command at ", F.col("test_at"), ".")),
        rule("broad_file_change", "broad", text(F.col("files_changed").cast("string"), " files changed in this session and no successful verification command covered the result."), F.lit("successful verification command covering this broad change")),
        rule("source_changed_without_test_change", "untested_source", text(F.col("source_changes").cast("string"), " source file change(s) recorded in this session, but no test files changed."), F.lit("test file change in the same session")),
    ))
    per_session = facts.select("session_id", F.explode(once).alias("r")).select("session_id", "r.*")
    command, at = quoted(collapse_space(F.col("command"))), F.coalesce("at", F.lit(""))
    flagged = commands.filter(C.is_destructive(F.col("command")) | C.is_network(F.col("command"))).join(facts.select("session_id", "needless_network"), "session_id")
    of_command = lambda kind, on, summary: F.when(on, F.struct(F.lit(RANK[kind]).alias("rank"), F.lit(kind).alias("type"), summary.alias("summary")))
    both = F.array_compact(F.array(
        of_command("destructive_command", C.is_destructive(F.col("command")), text("Destructive command ", command, " ran at ", at, ".")),
        of_command("network_call_without_need", F.col("needless_network") & C.is_network(F.col("command")), text("Network or install command ", command, " ran at ", at, " with no package or dependency file change in this session.")),
    ))
    none = F.lit(None).cast("string")
    per_command = flagged.select("session_id", F.col("idx").cast("long").alias("at_idx"), F.explode(both).alias("r")).select("session_id", "r.rank", "at_idx", "r.type", "r.summary", none.alias("missing"), none.alias("repeated"))
    kind = "repeated_failing_command"
    per_text = repeated_failures(commands).select("session_id", F.lit(RANK[kind]).alias("rank"), F.col("first_idx").cast("long").alias("at_idx"), F.lit(kind).alias("type"), text(quoted(F.col("command")), " failed ", F.col("failures").cast("string"), " times in this session.").alias("summary"), none.alias("missing"), F.col("command").alias("repeated"))
    rows = per_session.unionByName(per_command).unionByName(per_text)
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("session_id").orderBy("rank", "at_idx")))


def findings(changes: DataFrame, commands: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Findings in order: session_id, seq, finding_id, type, severity, confidence, summary, missing (string, null if none)."""
    rows = finding_rows(changes, commands, session_facts(changes, commands) if facts is None else facts)
    look = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (k, v[i]))), F.col("type"))
    return rows.select("session_id", "seq", F.format_string("%s.%04d", F.col("type"), F.col("seq")).alias("finding_id"), "type", look(0).alias("severity"), look(1).alias("confidence"), "summary", "missing")


def evidence_facts(changes: DataFrame, commands: DataFrame, facts: DataFrame, rows: DataFrame) -> DataFrame:
    """What each finding rests on: session_id, seq, fact_no, label, kind, at, path, operation, command, success, line (as a card shows it)."""
    columns = ("session_id", "seq", "fact_no", "label", "kind", "at", "path", "operation", "command", "success")
    none = F.lit(None).cast("string")
    by = W.partitionBy("session_id", "seq").orderBy("idx")

    def about(kind: str) -> DataFrame:
        return rows.filter(F.col("type") == kind).select(F.col("session_id").alias("r_id"), "seq", "at_idx", "repeated")

    def of_commands(found: DataFrame, on: Column, first: tuple[str, ...], other: str) -> DataFrame:
        df = commands.join(found, (F.col("session_id") == F.col("r_id")) & on).withColumn("fact_no", F.row_number().over(by))
        label = F.lit(other)
        for i, name in enumerate(first):
            label = F.when(F.col("fact_no") == i + 1, name).otherwise(label)
        return df.withColumns({"label": label, "kind": F.lit("command"), "path": none, "operation": none}).select(*columns)

    def change(label: str, at: str, path: str, operation: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit("file_change").alias("kind"), F.col(at).alias("at"), F.col(path).alias("path"), F.col(operation).alias("operation"), none.alias("command"), F.lit(None).cast("boolean").alias("success"))

    def ran(label: str, at: str, command: str, success: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit("command").alias("kind"), F.col(at).alias("at"), none.alias("path"), none.alias("operation"), F.col(command).alias("command"), success.alias("success"))

    kind = F.col("type")
    second = F.when(kind == "final_verification_failed", ran("last_verification_after_edit", "after_at", "after_command", F.col("after_success")))
    second = second.when(kind == "final_edit_after_last_test", ran("last_test_command", "test_at", "test_command", F.col("test_success")))
    second = second.when(kind.isin("missing_final_verification", "broad_file_change") & F.col("success_at").isNotNull(), ran("last_successful_verification", "success_at", "success_command", F.lit(True)))
    edited = rows.filter(kind.isin("final_verification_failed", "missing_final_verification", "final_edit_after_last_test", "broad_file_change")).select("session_id", "seq", "type").join(facts, "session_id")
    pair = edited.select("session_id", "seq", F.posexplode(F.array_compact(F.array(change("final_file_change", "edit_at", "edit_path", "edit_operation"), second))).alias("i", "f")).select("session_id", "seq", (F.col("i") + 1).alias("fact_no"), "f.*")
    failed = F.coalesce(F.col("success") == F.lit(False), F.lit(False))
    sources = changes.filter(C.is_source_file(F.col("path"))).join(about("source_changed_without_test_change"), F.col("session_id") == F.col("r_id")).withColumn("fact_no", F.row_number().over(by))
    sources = sources.withColumns({"label": F.format_string("source_file_change_%d", "fact_no"), "kind": F.lit("file_change"), "command": none, "success": F.lit(None).cast("boolean")})
    whole = (
        pair.select(*columns)
        .unionByName(of_commands(about("only_failed_verification"), C.is_verification(F.col("command")), ("first_failed_verification_command",), "failed_verification_command"))
        .unionByName(of_commands(about("destructive_command"), F.col("idx") == F.col("at_idx"), (), "destructive_command"))
        .unionByName(of_commands(about("network_call_without_need"), F.col("idx") == F.col("at_idx"), (), "network_command"))
        .unionByName(of_commands(about("repeated_failing_command"), failed & (collapse_space(F.col("command")) == F.col("repeated")), ("first_failed_command", "repeated_failed_command"), "failed_command"))
        .unionByName(sources.select(*columns))
    )
    said = F.when(F.col("kind") == "command", F.concat(F.lit("command "), quoted(F.col("command")))).otherwise(F.concat_ws(" ", "operation", "path"))
    outcome = F.when(F.col("success"), "succeeded").when(~F.col("success"), "failed")
    return whole.withColumn("line", F.concat_ws(" | ", F.nullif(F.coalesce("at", F.lit("")), F.lit("")), said, outcome))


def missing_evidence(changes: DataFrame, commands: DataFrame, rows: DataFrame) -> DataFrame:
    """What a session lacks, each text once, in order: session_id, place, text. Times of changes, then times and outcomes of commands, then what findings miss."""
    by = W.partitionBy("session_id").orderBy("idx")
    number = (F.row_number().over(by) - 1).cast("string")
    no_time = F.col("ts").isNull()
    name = lambda what, field: F.concat(F.lit(f"{what}["), F.col("i"), F.lit(f"].{field}"))
    of_changes = changes.withColumn("i", number).filter(no_time).select("session_id", F.lit(1).alias("part"), F.col("idx").cast("long").alias("at_idx"), F.lit(0).alias("step"), name("file_changes", "timestamp").alias("text"))
    gaps = F.array_compact(F.array(F.when(no_time, F.struct(F.lit(0).alias("step"), name("commands", "timestamp").alias("text"))), F.when(F.col("success").isNull(), F.struct(F.lit(1).alias("step"), name("commands", "success").alias("text")))))
    of_commands = commands.withColumn("i", number).select("session_id", F.lit(2).alias("part"), F.col("idx").cast("long").alias("at_idx"), F.explode(gaps).alias("g")).select("session_id", "part", "at_idx", "g.step", "g.text")
    of_findings = rows.filter("missing IS NOT NULL").select("session_id", F.lit(3).alias("part"), F.col("seq").cast("long").alias("at_idx"), F.lit(0).alias("step"), F.col("missing").alias("text"))
    first = of_changes.unionByName(of_commands).unionByName(of_findings).groupBy("session_id", "text").agg(F.min(F.struct("part", "at_idx", "step")).alias("at"))
    return first.select("session_id", F.row_number().over(W.partitionBy("session_id").orderBy("at")).alias("place"), "text")


def card_evidence(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """A card's lines of evidence, each once, in order: session_id, place, line. Per finding its summary, its facts, what is missing."""
    said = rows.select("session_id", "seq", F.explode(F.array_compact(F.array(F.struct(F.lit(1).alias("part"), F.lit(0).alias("fact_no"), F.col("summary").alias("line")), F.when(F.col("missing").isNotNull(), F.struct(F.lit(3).alias("part"), F.lit(0).alias("fact_no"), F.concat(F.lit("missing: "), "missing").alias("line")))))).alias("e")).select("session_id", "seq", "e.*")
    whole = said.unionByName(shown.select("session_id", "seq", F.lit(2).alias("part"), "fact_no", "line"))
    first = whole.groupBy("session_id", "line").agg(F.min(F.struct("seq", "part", "fact_no")).alias("at"))
    return first.select("session_id", F.row_number().over(W.partitionBy("session_id").orderBy("at")).alias("place"), "line")


def review_cards(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Per session: verdict, main finding, habit, skill, evidence lines (ordered, distinct, LF-joined), n_findings."""
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "summary", "missing", "type"))), lambda x: F.array_compact(F.array(x["summary"], F.concat(F.lit("missing: "), x["missing"])))))
    per = found.groupBy("session_id").agg(F.count("*").alias("n_findings"), F.min_by("summary", "seq").alias("main"), F.min_by("type", "seq").alias("main_type"), F.array_join(F.array_distinct(lines), "\n").alias("lines"))
    after = F.when(F.col("edit_at").isNotNull() & F.col("success_at").isNotNull(), F.concat(F.lit("verification_after_final_edit: "), (F.col("success_ts") >= F.col("edit_ts")).cast("string")))
    note = lambda label, c: F.concat(F.lit(label + ": "), F.col(c).cast("string"))
    proof = F.array_join(F.array_compact(F.array(note("files_changed", "files_changed"), note("commands_run", "commands_run"), note("tests_run", "tests_run"), note("final_file_edit_at", "edit_at"), note("last_test_command_at", "test_at"), note("last_successful_verification_at", "success_at"), after)), "\n")
    look = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (k, v[i]))), F.col("main_type"))
    df = facts.join(per, "session_id", "left")
    clean = F.col("n_findings").isNull()
    return df.select(
        "session_id",
        F.when(clean, "clean").otherwise("needs_attention").alias("verdict"),
        F.when(clean, "No evidence findings were detected in this session.").otherwise(F.col("main")).alias("main_finding"),
        F.when(clean, "Keep ending sessions with a visible verification command.").otherwise(look(2)).alias("suggested_next_habit"),
        F.when(~clean, look(3)).alias("suggested_skill"),
        F.when(clean, proof).otherwise(F.col("lines")).alias("evidence"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
    )
