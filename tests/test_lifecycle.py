"""A vault's life against small cases."""

import hashlib
import json

import pytest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_archive(spark):
    from sessionloom.plans import lifecycle as L

    receipt = {"schema_version": "memory_import_receipt.v1", "data_class": "redacted", "tool": "memory_store", "decision": "allowed", "namespace": "n", "content_class": "note", "memory_ids": ["a"], "supersedes": [], "received_at": "t"}
    bodies = {"/h/.claude/a": json.dumps(receipt), "/h/b": "plain", "/h/c": "plain", "/h/d": None, "/h/e": json.dumps(receipt | {"extra": 1}), "/h/f": json.dumps(receipt | {"error_class": "namespace_forbidden"}), "/h/g": "known"}
    files = spark.createDataFrame([(p, None if b is None else b.encode()) for p, b in bodies.items()], "path string, content binary")
    refs = spark.createDataFrame([(sha("known"),)], "digest string")
    plain = {r.path: (r.outcome, r.source, bool(r.warning), r.problem) for r in L.archived(files, refs).collect()}
    assert plain["/h/.claude/a"] == ("archived", "claude_code", True, None) and plain["/h/b"] == ("archived", "manual", False, None) and plain["/h/c"][0] == plain["/h/g"][0] == "deduped" and plain["/h/d"][::3] == ("refused", "content missing")
    pinned = {r.path: (r.outcome, r.problem) for r in L.archived(files, refs, "memory_import_receipt").collect()}
    assert pinned["/h/.claude/a"] == ("archived", None) and pinned["/h/e"] == ("refused", "invalid memory import receipt: $.extra: additional") and pinned["/h/f"][1].startswith("memory import receipt has namespace_forbidden") and pinned["/h/b"][0] == "refused"
    with pytest.raises(ValueError, match="unsupported raw kind"):
        L.archived(files, refs, "memory")
    assert L.archived(files.filter("1 = 0"), refs).count() == 0


def test_erase(spark):
    from sessionloom.plans import lifecycle as L
    from sessionloom.plans.vault import without_tombstoned

    one, two = sha("1"), sha("2")
    refs = spark.createDataFrame([(f"raw_{one}", one), (f"raw_{two}", two)], "raw_ref_id string, digest string")
    blobs = spark.createDataFrame([(one,), (sha("3"),)], "digest string")
    asked = spark.createDataFrame([(f" raw_{one} ", "why"), (f"raw_{one}", "again"), (f"raw_{two}", "gone"), (None, "x"), (f"raw_{one}", None), ("raw_x", "x"), (f"raw_{sha('9')}", "x")], "raw_ref_id string, reason string")
    stones, refused = L.erased(asked, refs, blobs, "now")
    assert sorted(map(tuple, stones.select("digest", "reason", "blob_removed", "erased_at").collect())) == sorted([(one, "again", True, "now"), (two, "gone", False, "now")])
    assert sorted(r.problem for r in refused.collect()) == sorted(["missing raw_ref_id", "missing erasure reason", 'invalid raw_ref_id "raw_x"', f"no raw ref raw_{sha('9')}"])
    assert [r.digest for r in without_tombstoned(blobs, stones).collect()] == [sha("3")]


def test_backup_and_status(spark):
    from sessionloom.plans import lifecycle as L

    rows = lambda *x: spark.createDataFrame(list(x), "vault string, path string, content string")
    files = rows(("a", "raw/1", "1"), ("a", "s", "2"), ("b", "s", "3"), ("c", "raw/1", "4"), ("d", "s", "5"))
    copies = rows(("a", "raw/1", "1"), ("a", "s", "2"), ("b", "s", "x"), ("d", "s", "5"), ("d", "t", "6"))
    consents = spark.createDataFrame([("a", "/b/a", True), ("b", "/b/b", False), ("c", "/b/c", None), ("d", "/b/d", True), ("e", "/b/e", False)], "vault string, destination string, allow_raw boolean")
    out = {r.vault: (r.file_count, r.raw_egress, bool(r.audit), r.verified, bool(r.problem)) for r in L.backed_up(files, copies, consents).collect()}
    assert out == {"a": (2, True, True, True, False), "b": (1, False, False, False, False), "c": (0, False, False, False, True), "d": (1, False, False, False, False), "e": (0, False, False, True, False)}
    blobs = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2")], "vault string, digest string")
    states = spark.createDataFrame([("a", "t", 2), ("z", None, None)], "vault string, last_backfill_at string, copy_failures long")
    assert sorted(map(tuple, L.status(blobs, blobs.limit(1), states).collect())) == [("a", "present", 2, 1, "t", 2), ("z", "missing", 0, 0, "-", 0)]


def test_receipts_are_parsed_once(spark):
    """A contract's rules share one reading of the text; refused receipts take no digest from others."""
    from sessionloom.plans import lifecycle as L

    receipt = {"schema_version": "memory_import_receipt.v1", "data_class": "redacted", "tool": "memory_store", "decision": "allowed", "namespace": "n", "content_class": "note", "memory_ids": ["a"], "supersedes": [], "received_at": "t"}
    texts = [json.dumps(receipt | {"embedding_dimensions": 1.5, "decision": "x"}), "[1]", "{", json.dumps({"schema_version": receipt["schema_version"]}), json.dumps(receipt), json.dumps(receipt)]
    files = spark.createDataFrame([(f"/h/{i}", x.encode()) for i, x in enumerate(texts)], "path string, content binary")
    out = L.archived(files, files.limit(0).selectExpr("path AS digest"), L.RECEIPTS)
    assert str(L.receipt_problem(files.content.cast("string"))).count("try_parse_json") == 1
    said = {r.path: (r.outcome, r.problem) for r in out.collect()}
    broken = "invalid memory import receipt: $"
    assert said == {"/h/0": ("refused", f"{broken}.decision: enum"), "/h/1": ("refused", f"{broken}: type"), "/h/2": ("refused", f"{broken}: type"), "/h/3": ("refused", f"{broken}.data_class: required"), "/h/4": ("archived", None), "/h/5": ("deduped", None)}
