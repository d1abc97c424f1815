"""Transcript lines are read and parsed once, calls and results meet after one shuffle; held against plain queues."""

import json
import random

from sessionloom.plans import normalize as N


def _lines(spark, n):
    rng = random.Random(n)
    rows = []
    for file in "ab":
        for i in range(n):
            block = rng.choice((
                {"type": "tool_use", "name": rng.choice(("Bash", "Edit")), "input": {"command": str(i)}},
                {"type": "tool_use", "name": "Bash", "id": f"i{rng.randrange(6)}"},
                {"type": "tool_result", "content": f"r{i}", **rng.choice(({"name": "Bash"}, {"name": "Edit"}, {}))},
                {"type": "tool_result", "content": f"r{i}", "tool_use_id": f"i{rng.randrange(8)}", **rng.choice(({"name": "Bash"}, {}))},
            ))
            rows.append((file, i, json.dumps(rng.choice((block, {"type": "assistant", "message": {"content": [block]}})))))
    return spark.createDataFrame(rows, "file string, line_no int, raw string")


def _plain(blocks):
    """Calls as (name, result) in order: by id the latest use takes the first result, then oldest open uses of the result's tool."""
    uses, results = ([(i, b) for i, b in enumerate(blocks) if b["type"] == t] for t in ("tool_use", "tool_result"))
    of_id, answer, left = {b["id"]: i for i, b in uses if "id" in b}, {}, []
    for i, b in results:
        at = of_id.get(b.get("tool_use_id"))
        if at is not None and at not in answer:
            answer[at] = b["content"]
        else:
            left.append(i)
    by_id, queues, alone = set(answer), {}, []
    for i, b in enumerate(blocks):
        if b["type"] == "tool_use" and i not in by_id:
            queues.setdefault(b["name"], []).append(i)
        elif i in left:
            if queues.get(b.get("name")):
                answer[queues[b["name"]].pop(0)] = b["content"]
            else:
                alone.append(i)
    return [(blocks[i].get("name", "ToolResult"), blocks[i]["content"] if i in alone else answer.get(i)) for i in sorted([i for i, _ in uses] + alone)]


def test_calls_after_one_shuffle(spark):
    lines = _lines(spark, 80)
    good, bad = N.parse_lines(lines)
    calls = N.tool_calls(good)
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan  # neither lines nor blocks are read twice
    assert calls._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = {}
    for r in calls.orderBy("file", "position").collect():
        found.setdefault(r.file, []).append((r.name, r.result))
    want = {}
    for r in lines.orderBy("file", "line_no").collect():
        record = json.loads(r.raw)
        want.setdefault(r.file, []).append(record["message"]["content"][0] if record["type"] == "assistant" else record)
    assert found == {f: _plain(b) for f, b in want.items()} and bad.count() == 0


def test_sessions_in_one_aggregate(spark):
    rows = [("a", 0, {"sessionId": "1", "timestamp": "2024-01-01T00:00:00.1234567Z"}), ("a", 1, {"session_id": "1", "timestamp": "2024-01-01T00:00:02Z"}), ("b", 0, {"session_id": "1"}), ("b", 1, {"session_id": "2"})]
    good, _ = N.parse_lines(spark.createDataFrame([(f, i, json.dumps({"type": "user", **r})) for f, i, r in rows], "file string, line_no int, raw string"))
    out = N.sessions(good)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()  # a distinct count has every row aggregated twice
    assert sorted((r.file, r.duration_seconds, r.problem) for r in out.collect()) == [("a", 1, None), ("b", None, "conflicting session ids")]


def test_documents_read_calls_once(spark):
    rows = [("a", 0, {"type": "session_start", "session_id": "1"})] + [("a", i + 1, {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": n, "input": x}]}}) for i, (n, x) in enumerate((
        ("Bash", {"command": " go test "}), ("bash", {"command": "ls"}), ("Bash", {"command": " "}), ("Edit", {"file_path": "f"}), ("Write", {"path": "g"}), ("Edit", {}), ("Read", {"path": "h"}),
    ))] + [("b", 0, {"type": "session_start", "session_id": "2"})]
    good, _ = N.parse_lines(spark.createDataFrame([(f, i, json.dumps(r)) for f, i, r in rows], "file string, line_no int, raw string"))
    out = N.documents(good)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # calls are made once for all counts
    assert sorted((r.session_id, r.turns, r.tool_calls, r.file_changes, r.commands, r.tests) for r in out.collect()) == [("1", 0, 7, 2, 2, 1), ("2", 0, 0, 0, 0, 0)]
