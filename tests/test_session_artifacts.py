"""Artifacts committed together, gates, stores and captures as a stream."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_redacted_sessions import SCHEMA, made_sessions, read

SECRET = "ghp_" + "a1" * 12


def transcript(secret):
    lines = [
        {"type": "session_start", "sessionId": "t", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/home/me/w"},
        {"type": "user", "message": {"role": "user", "content": f"use {secret} please"}, "timestamp": "2024-01-01T00:00:01Z"},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:02Z", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "u1", "name": "Edit", "input": {"file_path": "a.go"}}, {"type": "tool_use", "id": "u2", "name": "Bash", "input": {"command": f"token={secret} go test"}}]}},
        {"type": "user", "timestamp": "2024-01-01T00:00:03Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "u2", "content": f"{secret} <b>failed</b>", "is_error": True}]}},
        {"type": "session_end", "timestamp": "2024-01-01T00:01:00Z"},
    ]
    return [json.dumps(x) for x in lines]


@pytest.fixture
def spool(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = lambda s, path, **more: json.dumps({"session_id": s, "transcript_path": path, "cwd": "/w", "hook_event_name": "SessionEnd", "timestamp": "2024-01-01T00:02:00Z", **more})
    for name, body in {"a.json": event("s1", "one"), "b.json": event("s2", "two"), "c.json": event("s1", "one"), "d.json": event("s3", "nothing"), "e.json": event("s4", ""), "f.json": "{"}.items():
        (tmp_path / "in" / name).write_text(body)
    rows = [(f, i, x) for f in ("one", "two") for i, x in enumerate(transcript(SECRET))]
    lines = spark.createDataFrame(rows, "file string, line_no int, raw string")
    return tmp_path, lambda todo: lines.join(todo.select(F.col("transcript_path").alias("file")).distinct(), "file", "left_semi")


def contents(spark, root):
    from sessionloom.sources.commits import committed
    from sessionloom.streaming.drain_artifacts import TABLES

    out = {}
    for name in TABLES:
        rows = committed(spark, root, name)
        out[name] = [] if rows is None else sorted(map(tuple, rows.collect()))
    return out


def test_a_batch_is_committed_whole_or_not_at_all(spark, spool, monkeypatch):
    from sessionloom.plans.artifacts import ARTIFACTS
    from sessionloom.sources import commits
    from sessionloom.streaming.drain_artifacts import drain_artifacts

    where, lines = spool
    root, mark = str(where / "out"), str(where / "mark")
    real, calls = commits.write_stage, []

    def stopped(rows, path):
        calls.append(path)
        if len(calls) == 4:
            raise RuntimeError("stopped between two writes")
        real(rows, path)

    monkeypatch.setattr(commits, "write_stage", stopped)
    with pytest.raises(Exception, match="stopped between two writes"):
        drain_artifacts(spark, str(where / "in"), lines, root, mark)
    assert len(calls) == 4 and not any(contents(spark, root).values())  # three tables are staged, none is there
    monkeypatch.setattr(commits, "write_stage", real)
    drain_artifacts(spark, str(where / "in"), lines, root, mark)
    first = contents(spark, root)
    assert all([r[0] for r in first[a]] == ["s1", "s2"] for a in ARTIFACTS)
    assert [r[:2] for r in first["refused"]] == [("", "not JSON"), ("s3", "no sound session in transcript"), ("s4", "raw_missing")]
    drain_artifacts(spark, str(where / "in"), lines, root, mark)  # nothing new
    assert contents(spark, root) == first
    for name, rows in first.items():
        if name in ARTIFACTS:
            for session, artifact, path, body, digest in rows:
                assert path == f"sessions/{session}/{ARTIFACTS[name][0]}" and digest == "sha256:" + hashlib.sha256(body.encode()).hexdigest()
                assert (SECRET in body) == (artifact == "normalized_session") and ("/home/me" in body) == (artifact == "normalized_session")
    card = json.loads(first["review_card"][0][3])
    assert card["verdict"] == "needs_attention" and any(x.startswith("2024-01-01T00:00:02Z | command ") for x in card["evidence"])
    page = first["html_report"][0][3]
    digests = {r[1]: r[4] for a in ARTIFACTS for r in first[a] if r[0] == "s1"}
    assert page.count("<section ") == 7 and all((digests[a] in page) == (a != "html_report") for a in ARTIFACTS) and "redaction.secret_detected.0002" in page
    line = json.loads(first["export_line"][0][3])
    assert [x["class_"] for x in line["content"]] == ["TextObservation", "ApiAction", "CodeAction", "TextObservation"] and line["content"][1]["kwargs"] == {"file_path": "a.go"}
    from sessionloom.plans.contracts import routed

    bodies = [(a, r[3]) for a in ARTIFACTS if a != "html_report" for r in first[a]]
    told = routed(spark.createDataFrame(bodies, "artifact string, body string"), "body").collect()
    assert len(told) == 10 and all(r.violations == [] and r.schema_file for r in told), [(r.artifact, r.violations) for r in told]
    session = json.loads(first["normalized_session"][0][3])
    assert session["source_transcript_session_id"] == "t" and session["tool_calls"][0]["input"] == {"file_path": "a.go"}


def test_partial_sets_are_refused_and_imports_are_redacted(spark, spool):
    from sessionloom.plans.artifacts import imported_sessions
    from sessionloom.sources.commits import commit, committed
    from sessionloom.streaming.drain_artifacts import drain_artifacts

    where, lines = spool
    root = str(where / "out")
    rows = spark.createDataFrame([("s2", "review_card", "p", "{}", "d")], "session_id string, artifact string, path string, body string, digest string")
    assert commit({"review_card": rows}, root, "other") and not commit({"review_card": rows}, root, "other")
    with pytest.raises(Exception, match="s2: partial artifacts|not JSON"):
        drain_artifacts(spark, str(where / "in"), lines, root, str(where / "fast"), fail_fast=True)
    drain_artifacts(spark, str(where / "in"), lines, root, str(where / "mark"), imported=True)
    out = contents(spark, root)
    assert [r[0] for r in out["normalized_session"]] == ["s1"] and [r[0] for r in out["review_card"]] == ["s1", "s2"]
    assert ("s2", "partial artifacts, missing normalized.json,redacted.json,evidence.json,report.html,session.export.jsonl") in [r[:2] for r in out["refused"]]
    stored = json.loads(out["normalized_session"][0][3])
    assert stored["pipeline_status"] == "imported" and "redaction" not in stored and SECRET not in out["normalized_session"][0][3]
    bodies = committed(spark, root, "normalized_session").unionByName(committed(spark, root, "review_card")).unionByName(committed(spark, root, "evidence_bundle"))
    assert [r.session_id for r in imported_sessions(bodies).collect()] == ["s1"]


def test_gates(spark):
    from sessionloom.plans import gates
    from sessionloom.plans.redacted import not_redacted

    rows = spark.createDataFrame([("a", "redacted", ("redacted",)), ("b", "", ("redacted",)), ("c", "redacted", None)], "session_id string, pipeline_status string, redaction struct<status:string>")
    good, bad = gates.split(rows, not_redacted(rows))
    assert [r.session_id for r in good.collect()] == ["a"]
    assert {r.session_id: r.problem for r in bad.collect()} == {"b": 'pipeline_status "", want "redacted"', "c": "missing redaction summary"}
    with pytest.raises(gates.Refused, match='b: pipeline_status "", want "redacted"'):
        gates.split(rows, not_redacted(rows), fail=True)
    parts = {"x": spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "session_id string, v int"), "y": spark.createDataFrame([("a", 5), ("b", 6), (None, 7), ("z", 8)], "session_id string, v int")}
    whole, off = gates.context(parts)
    assert sorted(map(str, map(tuple, whole.collect()))) == ["('a', 1, 5)", "(None, 4, 7)"]
    assert {r.session_id: r.problem for r in off.collect()} == {"b": "x is repeated", "z": "x is missing"}
    with pytest.raises(gates.Refused, match="b: x is repeated"):
        gates.context(parts, fail=True)
    assert gates.only(rows, "session_id", " a ").count() == 1
    for value, said in (("q", "not found"), ("b", "twice")):
        with pytest.raises(gates.Refused, match=said):
            gates.only(parts["x"], "session_id", value)


def test_stores(spark):
    from sessionloom.plans.store import merged, transcript_bytes, upserted

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    store = lambda rows: spark.createDataFrame([(d, None if c is None else c.encode()) for d, c in rows], "digest string, content binary")
    a, b = store([(sha("1"), "1"), (sha("2"), "2"), (sha("2"), "2"), (sha("3"), "x")]), store([(sha("2"), "2"), (sha("3"), "3"), (sha("4"), None), ("AB", "5")])
    good, bad = merged(a, b)
    blobs = lambda df: sorted((r.digest, bytes(r.content)) for r in df.collect())
    assert blobs(good) == sorted([(sha("1"), b"1"), (sha("2"), b"2"), (sha("3"), b"3")])
    assert sorted((r.origin, r.problem) for r in bad.collect()) == [(1, "content does not match digest"), (2, "content missing"), (2, "digest is not 64 lower-case hexadecimal digits")]
    for other in (a, b, good):
        assert blobs(merged(good, other)[0]) == blobs(merged(other, good)[0]) == blobs(good)
    refs = spark.createDataFrame([("r1", "d1")], "raw_id string, digest string")
    new = spark.createDataFrame([("r1", "d1"), ("r1", "d2"), ("r2", "d3"), ("r2", "d3"), ("r2", "d1")], "raw_id string, digest string")
    kept, off = upserted(refs, new, [])
    assert sorted(map(tuple, kept.collect())) == [("r1", "d1"), ("r2", "d1")]
    assert sorted(r.problem for r in off.collect()) == ["raw ref r1 is of digest d1, not d2", "raw ref r2 is of digest d1, not d3", "raw ref r2 is of digest d1, not d3"]
    events = spark.createDataFrame([("p", "sha256:" + sha("1")), ("q", "sha256:" + sha("2")), ("q", None), ("gone", "sha256:" + sha("3"))], "transcript_path string, digest string")
    live = spark.createDataFrame([("p", b"1"), ("q", b"changed")], "path string, content binary")
    got = sorted((r.transcript_path, str(r.content and bytes(r.content)), str(r.origin), str(r.problem)) for r in transcript_bytes(events, live, a).collect())
    bad_blob = f"blob blobs/{sha('3')[:2]}/{sha('3')} does not match its digest"
    assert got == [("gone", "None", "None", bad_blob), ("p", "b'1'", "live", "None"), ("q", "b'2'", "blob", "None"), ("q", "b'changed'", "live", "None")]


def test_captures_count_alike_however_the_spool_is_split(spark, tmp_path):
    from sessionloom.streaming.capture_state import capture_states, drain_captures

    rows = [{"vault": f"v{i % 2}", "event_id": f"e{i}", "at": f"2024-01-01T00:00:{i:02d}Z", "outcome": ("copied", "missing", "failed")[i % 3]} for i in range(20)]
    want = sorted((v, max(r["at"] for r in own), len(own), sum(r["outcome"] == "missing" for r in own), sum(r["outcome"] == "failed" for r in own)) for v in ("v0", "v1") for own in [[r for r in rows if r["vault"] == v]])
    for n, cuts in enumerate(([20], [3, 9, 20])):
        spool, out, mark = (str(tmp_path / f"{x}{n}") for x in ("in", "out", "mark"))
        (tmp_path / f"in{n}").mkdir()
        for i, (lo, hi) in enumerate(zip([0, *cuts], cuts, strict=False)):
            (tmp_path / f"in{n}" / f"{i}.json").write_text("\n".join(map(json.dumps, rows[lo:hi])))
            if i != 1:  # the second file waits for the third
                drain_captures(spark, spool, out, mark, files_per_batch=1)
        assert sorted(map(tuple, capture_states(spark.read.parquet(out)).collect())) == want


def test_redacted_documents_as_sessions_equal_the_reader(spark):
    """On the smallest given table, whose documents hold secrets."""
    import os

    from sessionloom.plans.redacted import redact_sessions
    from sessionloom.registry_refinery import document_sessions

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    sessions = document_sessions(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    given = {r["session_id"]: r for r in (x.asDict(True) for x in sessions.collect())}
    good, refused = redact_sessions(sessions)
    assert refused.count() == 0 and set(c.split()[0] for c in SCHEMA.split(", ")) == set(sessions.columns) and made_sessions()
    n = 0
    for row in (x.asDict(True) for x in good.collect()):
        doc, reader = read(given[row["session_id"]])
        assert [tuple(f.values()) for f in row["redaction"]["findings"]] == reader.findings
        assert [x["content"] for x in row["turns"]] == [x["content"] for x in doc["turns"]] and [x["output"] for x in row["commands"]] == [x["output"] for x in doc["commands"]]
        assert [json.loads(x["input"]) for x in row["tool_calls"]] == [x["input"] for x in doc["tool_calls"]]
        n += any("input" in f[2] or "turns" in f[2] or "commands" in f[2] for f in reader.findings)
    assert n > 0
