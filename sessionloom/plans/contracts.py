"""Contracts of documents as data: schemas by version, documents routed to their own, one generated check for each."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted, trim_space
from ..sources.files import EVENT_SOURCE, EVENT_VERSION, TIMESTAMP_SOURCES
from .artifacts import CARD_VERSION, EVIDENCE_VERSION
from .normalize import SESSION_VERSION
from .quality import LATTICE, schema_violations
from .redacted import REDACTED, SUMMARY_VERSION
from .vault import KINDS

# What a receipt may say.
RECEIPT_VERSION = "memory_import_receipt.v1"
ERROR_CLASSES = (
    "namespace_escape", "namespace_forbidden", "missing_scope", "content_too_large", "metadata_too_large", "invalid_input", "empty_content", "blocked_secret", "confirmation_required", "invalid_content_class", "duplicate_of_deleted", "duplicate_with_supersedes",
    "unknown_memory_id", "persistence_unavailable", "tool_failure", "upstream_unavailable",
)
CONTENT_CLASSES = ("note", "profile", "preference", "project_context", "coding_context", "workflow_rule", "decision", "relationship", "reference", "project_checkpoint", "connector_test")
_TEXT, _COUNT, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}


def _object(required: list[str], closed: bool = True, **properties: dict) -> dict:
    return {"type": "object", "required": required, "properties": properties, **({"additionalProperties": False} if closed else {})}


def _texts(*names: str) -> dict[str, dict]:
    return dict.fromkeys(names, _TEXT)


def _list(items: dict) -> dict:
    return {"type": "array", "items": items}


_FINDING = _object(["id", "type", "field", "replacement_count", "placeholders"], **_texts("id", "type", "field"), replacement_count=_COUNT, placeholders=_list(_TEXT))
_SUMMARY = _object(["schema_version", "status", "findings"], schema_version={"const": SUMMARY_VERSION}, data_class={"const": REDACTED}, status={"const": REDACTED}, findings=_list(_FINDING), secret_placeholders=_COUNT, path_placeholders=_COUNT)
_FACT = _object(["label", "kind"], False, label=_TEXT, kind={"enum": ["file_change", "command"]}, success=_FLAG)
_FOUND = _object(["finding_id", "type", "title", "summary", "evidence", "missing_evidence"], **_texts("finding_id", "type", "title", "summary"), severity={"enum": ["high", "medium", "low"]}, confidence={"enum": ["high", "medium", "low"]}, evidence=_list(_FACT), missing_evidence=_list(_TEXT))
#: Version -> (file, schema).
SCHEMAS: dict[str, tuple[str, dict]] = {
    "1.1.0": ("schemas/export.v1.schema.json", _object(["schema_version", "data_class", "id", "content", "details"], schema_version={"const": "1.1.0"}, data_class={"const": "corpus"}, id=_TEXT, details=_object(["source"], source=_TEXT),
        content=_list(_object(["class_"], class_={"enum": ["TextObservation", "ApiAction", "CodeAction"]}, source={"enum": ["user", "agent", "environment"]}, kwargs={"type": "object"}, **_texts("content", "function", "language", "code"))))),
    EVENT_VERSION: ("schemas/event.v1.schema.json", _object(["schema_version", "event_id", "source", "event_type", "timestamp", "session_ref", "workspace"], schema_version={"const": EVENT_VERSION}, data_class={"const": "raw"}, event_id=_TEXT, source={"const": EVENT_SOURCE},
        event_type={"enum": ["session_start", "session_end"]}, timestamp=_TEXT, timestamp_source={"enum": [x for x in TIMESTAMP_SOURCES if x]}, session_ref=_object(["session_id"], **_texts("session_id", "transcript_path")), workspace=_object(["cwd"], cwd=_TEXT), raw=_object([], raw_missing=_FLAG, digest=_TEXT))),
    EVIDENCE_VERSION: ("schemas/evidence.v1.schema.json", _object(["schema_version", "session_id", "summary", "findings", "missing_evidence"], schema_version={"const": EVIDENCE_VERSION}, data_class={"const": REDACTED}, **_texts("session_id", "source_event_id"),
        summary=_object(["status", "source"], False, status={"const": "complete"}, source={"const": EVENT_SOURCE}, files_changed=_COUNT, commands_run=_COUNT, tests_run=_COUNT), findings=_list(_FOUND), missing_evidence=_list(_TEXT))),
    RECEIPT_VERSION: ("schemas/memory_import_receipt.v1.schema.json", _object(["schema_version", "data_class", "tool", "decision", "namespace", "content_class", "memory_ids", "supersedes", "received_at"], schema_version={"const": RECEIPT_VERSION}, data_class={"const": "redacted"}, tool={"const": "memory_store"},
        decision={"enum": ["allowed", "denied"]}, outcome={"enum": ["created", "duplicate"]}, error_class={"enum": list(ERROR_CLASSES)}, content_class={"enum": list(CONTENT_CLASSES)}, memory_ids=_list(_TEXT), supersedes=_list(_TEXT), superseded_memory_ids=_list(_TEXT), embedding_dimensions=_COUNT,
        **_texts("namespace", "embedding_provider", "embedding_model_id", "received_at"))),
    "raw_ref.v1": ("schemas/raw_ref.v1.schema.json", _object(["schema_version", "data_class", "raw_ref_id", "source", "kind", "digest", "size_bytes", "observed_at", "local_only"], schema_version={"const": "raw_ref.v1"}, data_class={"const": "raw"}, kind={"enum": list(KINDS)}, size_bytes=_COUNT, local_only={"const": True},
        **_texts("raw_ref_id", "source", "source_session_id", "digest", "original_path", "archived_path", "observed_at"))),
    "raw_tombstone.v1": ("schemas/raw_tombstone.v1.schema.json", _object(["schema_version", "digest", "erased_at"], schema_version={"const": "raw_tombstone.v1"}, data_class={"const": "raw"}, blob_removed=_FLAG, **_texts("digest", "erased_at", "reason"))),
    SUMMARY_VERSION: ("schemas/redaction_summary.v1.schema.json", _SUMMARY),
    CARD_VERSION: ("schemas/review_card.v1.schema.json", _object(["schema_version", "session_id", "verdict", "main_finding", "evidence", "suggested_next_habit", "warnings"], schema_version={"const": CARD_VERSION}, data_class={"const": "review"}, verdict={"enum": ["clean", "needs_attention"]}, evidence=_list(_TEXT), warnings=_list(_TEXT),
        **_texts("session_id", "main_finding", "suggested_next_habit", "suggested_skill", "source_event_id"))),
    "scorecard.v1": ("schemas/scorecard.v1.schema.json", _object(["schema_version", "headline", "dimensions"], False, schema_version={"const": "scorecard.v1"}, headline={"enum": ["TRUSTED", "TRUSTED-WITH-NAMED-GAPS", "NOT-TRUSTED"]}, dimensions=_list(_object(["id", "state"], False, id=_TEXT, state={"enum": ["GREEN", "KNOWN-RED", "BLOCKING-RED"]})))),
    SESSION_VERSION: ("schemas/session.v1.schema.json", _object(["schema_version", "session_id", "source", "turns", "tool_calls", "file_changes", "commands"], schema_version={"const": SESSION_VERSION}, data_class={"enum": list(LATTICE)}, source={"const": EVENT_SOURCE}, workspace={"type": "object"}, git={"type": "object"}, provenance={"type": "object"}, redaction=_SUMMARY,
        turns=_list(_object(["role", "content"], False, role={"enum": ["user", "assistant"]}, content=_TEXT)), tool_calls=_list(_object(["tool_call_id", "name", "input"], False, input={"type": "object"}, **_texts("tool_call_id", "name"))), file_changes=_list(_object(["path", "operation"], False, **_texts("path", "operation"))), commands=_list(_object(["command"], False, command=_TEXT)),
        **_texts("pipeline_status", "session_id", "agent_model", "workspace_id", "repo_id", "transcript_path", "source_transcript_session_id", "started_at", "ended_at", "source_event_id"))),
    "vault_state.v1": ("schemas/vault_state.v1.schema.json", _object(["schema_version"], schema_version={"const": "vault_state.v1"}, raw_missing=_COUNT, copy_failures=_COUNT, captured=_COUNT, last_capture_at=_TEXT)),
}


def registry(spark: SparkSession, schemas: dict[str, tuple[str, dict]] = SCHEMAS) -> DataFrame:
    """(schema_version, file, schema) in lexical order of the versions; a version or a file that is there twice or empty is refused."""
    files = [f for f, _ in schemas.values()]
    if len(set(files)) < len(files) or not all(files) or not all(schemas):
        raise ValueError("registered versions and files must be unique and not empty")
    return spark.createDataFrame([(v, f, json.dumps(s)) for v, (f, s) in sorted(schemas.items())], "schema_version string, file string, schema string")


def enum_values(schemas: dict[str, tuple[str, dict]] = SCHEMAS) -> list[tuple[str, str, str]]:
    """(version, property, value) of every enum of strings among the top properties."""
    return [(v, name, x) for v, (_, s) in sorted(schemas.items()) for name, p in s["properties"].items() for x in p.get("enum", ()) if isinstance(x, str)]


def routed(documents: DataFrame, body: str, schemas: dict[str, tuple[str, dict]] = SCHEMAS) -> DataFrame:
    """``documents`` with ``schema_version`` (trimmed), ``schema_file`` and ``violations`` (array, empty if sound) of the JSON in ``body``.

    Each document meets the check of its own version only; those of an unknown
    version, of none, and what is no JSON object, break the rule of having one.
    """
    v = F.col("_v")
    df = documents.withColumn("_v", F.try_parse_json(body))
    an_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    version = trim_space(F.coalesce(F.when(an_object, F.try_variant_get(v, "$.schema_version", "string")), F.lit("")))
    df = df.withColumns({"schema_version": version, "_object": an_object})
    known = F.col("schema_version")
    unknown = F.array(F.when(~F.col("_object"), F.lit("$: no JSON object")).when(known == "", F.lit("$.schema_version: required")).otherwise(F.concat(F.lit("$.schema_version: unknown "), quoted(known))))
    checks = reduce(lambda found, vs: found.when(known == vs[0], schema_violations(v, vs[1][1])), schemas.items(), F.when(F.lit(False), unknown))
    file = F.element_at(F.create_map(*(F.lit(x) for k, (f, _) in schemas.items() for x in (k, f))), known)
    return df.withColumns({"violations": checks.otherwise(unknown), "schema_file": file}).drop("_v", "_object")


def enum_usage(documents: DataFrame, body: str, schemas: dict[str, tuple[str, dict]] = SCHEMAS) -> DataFrame:
    """(schema_version, property, value, n): how many documents of a version use each value its schema lists, 0 included."""
    listed = enum_values(schemas)
    spark = documents.sparkSession
    names = sorted({p for _, p, _ in listed})
    each = F.array(*(F.struct(F.lit(p).alias("property"), F.get_json_object(body, f"$.{p}").alias("value")) for p in names))
    used = documents.select(trim_space(F.get_json_object(body, "$.schema_version")).alias("u_version"), F.explode(each).alias("x")).groupBy("u_version", F.col("x.property").alias("u_property"), F.col("x.value").alias("u_value")).agg(F.count("*").alias("n"))
    rows = spark.createDataFrame(listed, "schema_version string, property string, value string")  # as many as the schemas list
    on = (F.col("schema_version") == F.col("u_version")) & (F.col("property") == F.col("u_property")) & (F.col("value") == F.col("u_value"))
    return rows.join(used, on, "left").select("schema_version", "property", "value", F.coalesce("n", F.lit(0)).alias("n"))


def reclassified(before: Column, after: Column) -> Column:
    """Why data of one class may not become another's, null if it may: both must be known, and the rank may not fall."""
    rank = lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in LATTICE.items() for x in kv)), c)
    return F.when(rank(before).isNull(), F.concat(F.lit("unknown data class "), quoted(before))).when(rank(after).isNull(), F.concat(F.lit("unknown data class "), quoted(after))).when(rank(after) < rank(before), F.concat(F.lit("data class falls from "), before, F.lit(" to "), after))
