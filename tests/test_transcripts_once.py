"""Events become transcript lines in one pass over them, and lines that parse never leave the engine."""

from sessionloom.plans import activity as A
from sessionloom.plans import normalize as N
from sessionloom.plans.transcripts import transcripts

SF = "/root/testdata/sf0.001"


def test_lines_are_made_where_sessions_lie(spark):
    lines = transcripts(A.activity(spark, SF))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and "Aggregate" not in plan  # events are neither joined with themselves nor read again
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    events, sessions = spark.read.parquet(f"{SF}/events.parquet").count(), A.activity(spark, SF).select("session_id").distinct().count()
    assert lines.count() == 3 * events + 2 * sessions == lines.select("file", "line_no").distinct().count()
    ends = {r.file: (r.least, r.most) for r in lines.groupBy("file").agg({"line_no": "min"}).withColumnRenamed("min(line_no)", "least").join(lines.groupBy("file").agg({"line_no": "max"}).withColumnRenamed("max(line_no)", "most"), "file").collect()}
    assert all(ends[r.session_id] == (0, 3 * r["count"] + 1) for r in A.activity(spark, SF).groupBy("session_id").count().collect())


def test_only_odd_lines_are_tried_again(spark, monkeypatch):
    monkeypatch.setattr(N, "MAX_LINE", 40)
    raw = ['{"type":"user"}', ' {"a":1,"a":2,"b":{"c":1,"c":3}} ', "{broken", " \t", "", '"' + "x" * 40 + '"', "[1]", None]
    good, bad = N.parse_lines(spark.createDataFrame([("f", i, x) for i, x in enumerate(raw)], "file string, line_no int, raw string"))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and plan.count("Relation") == 1  # one scan, nothing of it through Python
    assert {r.line_no: r.v.toJson() if hasattr(r.v, "toJson") else str(r.v) for r in good.collect()} == {0: '{"type":"user"}', 1: '{"a":2,"b":{"c":3}}', 6: "[1]"}
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [(2, "not JSON"), (5, "line too long")]
