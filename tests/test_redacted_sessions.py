"""Whole sessions redacted, against a reader that visits one string after another."""

import json
import random
import re

from test_refinery import _model

BITS = ["password=hunter22,", "token abc.", "ghp_" + "a1" * 12, "git@host.org:a/b.git", "/home/me/.ssh/id", "~/.aws/credentials;", "aB3+xY9/kL5=pQ7_rS1-tU8mN2vW4zC6", "word", "[REDACTED_PATH_001]", "é", 'a "b" \\ c', "sk-" + "Ab1" * 9, "plain_key", "k.dot"]


class Reader:
    def __init__(self):
        self.numbers, self.findings = {"SECRET": {}, "PATH": {}}, []

    def text(self, field, value, meta=False):
        if not value:
            return value
        marked = _model(value, made := [])
        if meta and marked == value and value.strip() and "REDACTED_" not in value:
            from hashlib import sha256

            marked = f"[REDACTED_SECRET_{sha256(value.encode()).hexdigest()[:16]}]"
            made.append(marked)
        told = []
        for mark in made:
            kind = mark[10:].split("_")[0]
            told.append("[REDACTED_%s_%03d]" % (kind, self.numbers[kind].setdefault(mark, len(self.numbers[kind]) + 1)))
        for kind, name in (("SECRET", "secret_detected"), ("PATH", "path_redacted")):
            if own := [x for x in told if kind in x]:
                self.findings.append((f"redaction.{name}.{len(self.findings) + 1:04d}", f"redaction.{name}", field, len(own), sorted(set(own))))
        return re.sub(r"\[REDACTED_(SECRET|PATH)_[0-9a-f]{16}\]", lambda m: "[REDACTED_%s_%03d]" % (m[1], self.numbers[m[1]][m[0]]), marked)

    def value(self, field, v):
        if isinstance(v, str):
            return self.text(field, v)
        if isinstance(v, list):
            return [self.value(f"{field}[{i}]", x) for i, x in enumerate(v)]
        if isinstance(v, dict):
            out = {}
            for i, k in enumerate(sorted(v)):
                shown = self.text(f"{field}.[key_{i + 1:03d}]", k)
                if shown in out:
                    raise ValueError(f'{field}.[key_{i + 1:03d}] redacts to duplicate key "{shown}"')
                same = shown == k and re.fullmatch("[A-Za-z0-9_-]{1,80}", k)
                out[shown] = self.value(f"{field}.{k}" if same else f"{field}.[key_{i + 1:03d}]", v[k])
            return out
        return v


BEFORE = {"agent_model": "agent_model", "workspace_id": "workspace_id", "repo_id": "repo_id", "transcript_path": "transcript_path", "source_transcript_session_id": "source_transcript_session_id", "cwd": "workspace.cwd"}
AFTER = {"started_at": "started_at", "ended_at": "ended_at", "source_event_id": "source_event_id", "git_remote": "git.remote", "git_branch": "git.branch", "git_head_sha": "git.head_sha"}


def read(s):
    r, out = Reader(), dict(s)
    for c, label in BEFORE.items():
        out[c] = r.text(label, s[c])
    out["turns"] = [{**t, "content": r.text(f"turns[{i}].content", t["content"])} for i, t in enumerate(s["turns"])]
    calls = []
    for i, c in enumerate(s["tool_calls"]):
        given = r.value(f"tool_calls[{i}].input", json.loads(c["input"]))
        calls.append({**c, "input": given, "result": r.text(f"tool_calls[{i}].result", c["result"])})
    out["tool_calls"] = calls
    out["file_changes"] = [{**x, "path": r.text(f"file_changes[{i}].path", x["path"])} for i, x in enumerate(s["file_changes"])]
    out["commands"] = [{**x, "command": r.text(f"commands[{i}].command", x["command"]), "output": r.text(f"commands[{i}].output", x["output"])} for i, x in enumerate(s["commands"])]
    for c, label in AFTER.items():
        out[c] = r.text(label, s[c], True)
    if s["provenance"] is not None:
        out["provenance"] = r.value("provenance", json.loads(s["provenance"]))
    return out, r


def made_sessions():
    rng = random.Random(11)
    text = lambda: rng.choice([" ", "", "; "]).join(rng.choice(BITS) for _ in range(rng.randint(0, 4)))

    def value(depth):
        kind = rng.randrange(6)
        if depth and kind < 2:
            return {rng.choice([text(), rng.choice(BITS), "n" + str(rng.randrange(9))]): value(depth - 1) for _ in range(rng.randrange(4))}
        if depth and kind == 2:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return rng.choice([text(), text(), True, None, rng.randrange(100)])

    def obj(depth):
        return {f"{rng.choice(['a', 'Z', 'b.c', 'token x', 'é'])}{i}": value(depth) for i in range(rng.randrange(4))}

    out = []
    for n in range(40):
        some = lambda x: rng.choice([x, x, None])
        out.append({
            "session_id": f"s{n}", "schema_version": "session.v1", "source": "claude_code", "agent_model": some("m"), "workspace_id": some(text()), "repo_id": some("r"), "transcript_path": "/home/me/t.jsonl", "source_transcript_session_id": some(text()),
            "cwd": some("/home/me/w"), "started_at": some("2024-01-01T00:00:00Z"), "ended_at": "2024-01-01T00:00:00Z", "source_event_id": some("evt_1"), "git_remote": some("git@host.org:a/b.git"), "git_branch": some("main"), "git_head_sha": some("deadbeef" * 5),
            "provenance": some(json.dumps(obj(2))),
            "turns": [{"role": "user", "timestamp": None, "content": text()} for _ in range(rng.randrange(4))],
            "tool_calls": [{"tool_call_id": f"t{i}", "name": "X", "timestamp": None, "input": json.dumps(obj(3), ensure_ascii=False), "success": None, "result": some(text()), "result_timestamp": None} for i in range(rng.randrange(4))],
            "file_changes": [{"path": rng.choice(["/home/me/a.go", "b.go"]), "operation": "edit", "timestamp": None} for _ in range(rng.randrange(3))],
            "commands": [{"command": text(), "timestamp": None, "success": True, "output": some(text())} for _ in range(rng.randrange(3))],
        })
    meet = dict(out[0], session_id="meet", tool_calls=[{**{k: None for k in ("timestamp", "success", "result", "result_timestamp")}, "tool_call_id": "t", "name": "X", "input": json.dumps({"ok": {"[REDACTED_PATH_002]": 1, "/home/me/zz": 2}})}], cwd=None)
    return [*out, meet, dict(out[0], session_id="unsound", schema_version="other")]


SCHEMA = ", ".join(f"{c} string" for c in ("session_id", "schema_version", "source", *BEFORE, *AFTER, "provenance")) + (
    ", turns array<struct<role:string,timestamp:string,content:string>>, tool_calls array<struct<tool_call_id:string,name:string,timestamp:string,input:string,success:boolean,result:string,result_timestamp:string>>"
    ", file_changes array<struct<path:string,operation:string,timestamp:string>>, commands array<struct<command:string,timestamp:string,success:boolean,output:string>>"
)


def test_redacted_sessions_equal_the_reader(spark):
    from sessionloom.plans.redacted import not_redacted, redact_sessions

    given = made_sessions()
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(s[c] for c in columns) for s in given], SCHEMA)
    good, refused = redact_sessions(df)
    got = {r["session_id"]: r for r in (x.asDict(True) for x in good.collect())}
    want, problems, deep = {}, {"unsound": "unsupported schema_version"}, 0
    for s in given[:-1]:
        try:
            want[s["session_id"]] = read(s)
        except ValueError as e:
            problems[s["session_id"]] = str(e)
    assert {r.session_id: r.problem for r in refused.collect()} == problems and "meet" in problems
    assert got.keys() == want.keys()
    for sid, (doc, reader) in want.items():
        row = got[sid]
        for c in columns:
            value = row[c]
            if c == "provenance" and value is not None:
                value = json.loads(value)
            if c == "tool_calls":
                value = [{**x, "input": json.loads(x["input"])} for x in value]
            assert value == doc[c], (sid, c)
        summary = row["redaction"]
        assert [tuple(f.values()) for f in summary["findings"]] == reader.findings, sid
        assert (summary["secret_placeholders"], summary["path_placeholders"]) == (len(reader.numbers["SECRET"]), len(reader.numbers["PATH"]))
        assert (row["pipeline_status"], row["data_class"], summary["status"]) == ("redacted",) * 3
        deep += any("[key_" in f[2] or "input." in f[2] for f in reader.findings)
    assert deep > 10
    assert good.filter(not_redacted(good).isNotNull()).count() == 0
    assert redact_sessions(df.filter("1 = 0"))[0].count() == 0


def test_only_strings_that_a_pass_may_touch_become_rows(spark):
    from sessionloom.plans.redacted import redact_sessions, session_strings

    plain = dict(made_sessions()[0], session_id="plain", cwd="/w", transcript_path="t", provenance=None, git_remote=None, workspace_id=None, source_transcript_session_id=None)
    plain |= {"turns": [{"role": "user", "timestamp": None, "content": f"look at {i}"} for i in range(50)], "commands": [{"command": f"go test ./p{i}", "timestamp": None, "success": True, "output": "ok"} for i in range(50)], "file_changes": []}
    call = lambda i, given: {"tool_call_id": f"t{i}", "name": "X", "timestamp": None, "input": json.dumps(given), "success": None, "result": "got 1", "result_timestamp": None}
    hidden = call(51, {"a": ["x", ""], "b": "1"})
    hidden["input"] = hidden["input"].replace('"1"', '"\\u002fhome\\u002fme"')  # found in its plain form only
    plain["tool_calls"] = [*(call(i, {"command": f"make {i}"}) for i in range(50)), hidden]
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(plain[c] for c in columns)], SCHEMA)
    fields = sorted(r.field for r in session_strings(df).collect())
    assert fields == sorted([AFTER[c] for c in AFTER if plain[c]] + [f"tool_calls[50].input{x}" for x in (".[key_001]", ".[key_002]", ".a[0]", ".a[1]", ".b")])
    doc, reader = read(plain)
    row = redact_sessions(df)[0].first().asDict(True)
    assert [json.loads(x["input"]) for x in row["tool_calls"]] == [x["input"] for x in doc["tool_calls"]]
    assert (row["turns"], row["commands"]) == (doc["turns"], doc["commands"])
    assert [tuple(f.values()) for f in row["redaction"]["findings"]] == reader.findings


def test_what_no_pass_may_touch_no_pass_matches(spark):
    from pyspark.sql import functions as F

    from sessionloom.functions import redaction as R

    rng = random.Random(5)
    more = ["https://me:pw@host/x", "C:\\Users\\me\\x", "D:\\temp\\a", "-----BEGIN PRIVATE KEY-----\nab\n-----END PRIVATE KEY-----", "a" * 12 + "." + "b" * 12 + "." + "c" * 7, "./a/b.env", "PASSWD\n=\nx1", "JWT\tabc", "xoxb-" + "1a" * 12, "\n" + "aB3+xY9/kL5=pQ7_rS1-tU8mN2vW4zC6", "http://a.b/c", "\x01", "./p", "/work/x"]
    texts = [rng.choice(["", " ", "\n", '"', "\\"]).join(rng.choice(BITS + more) for _ in range(rng.randint(1, 3))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("j", F.to_json(F.array("t")))
    hit = F.greatest(*(F.col("t").rlike(pattern).cast("int") for _, _, pattern, _ in R.PASSES)) == 1
    rows = df.select("t", hit.alias("hit"), R.may_touch(F.col("t")).alias("may"), R.may_touch(F.col("j")).alias("may_json")).collect()
    assert [r.t for r in rows if r.hit and not (r.may and r.may_json)] == []
    assert sum(r.hit for r in rows) > 100 and sum(not r.may for r in rows) > 20
