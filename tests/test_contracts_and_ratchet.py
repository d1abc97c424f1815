"""Schemas as data, and a scorecard that may not get worse."""

import datetime

import pytest


def test_registry(spark):
    from sessionloom.plans import contracts as C

    rows = C.registry(spark).collect()
    assert [r.schema_version for r in rows] == sorted(C.SCHEMAS) and len({r.file for r in rows}) == len(rows)
    for broken in ({"a": ("f", {}), "b": ("f", {})}, {"": ("f", {})}, {"a": ("", {})}):
        with pytest.raises(ValueError, match="unique"):
            C.registry(spark, broken)
    schema = {"v1": ("f", {"type": "object", "properties": {"data_class": {"enum": ["raw", "redacted"]}, "n": {"enum": [1]}, "x": {}}})}
    assert C.enum_values(schema) == [("v1", "data_class", "raw"), ("v1", "data_class", "redacted")]


def test_documents_meet_their_own_schema(spark):
    from sessionloom.plans.contracts import routed

    schemas = {"v1": ("one", {"type": "object", "required": ["a"], "properties": {"schema_version": {"const": "v1"}, "a": {"type": "integer"}}, "additionalProperties": False}), "v2": ("two", {"type": "object", "properties": {"a": {"type": "string"}}})}
    bodies = {
        '{"schema_version":"v1","a":1.0}': ("one", []), '{"schema_version":"v1","a":1.5}': ("one", ["$.a: type"]), '{"schema_version":"v1","b":1}': ("one", ["$.a: required", "$.b: additional"]), '{"schema_version":"v2","a":1}': ("two", ["$.a: type"]), '{"schema_version":"v2","a":"1","b":1}': ("two", []),
        '{"schema_version":"v3"}': (None, ['$.schema_version: unknown "v3"']), "{}": (None, ["$.schema_version: required"]), "[]": (None, ["$: no JSON object"]), "x": (None, ["$: no JSON object"]), None: (None, ["$: no JSON object"]),
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert {r.body: (r.schema_file, r.violations) for r in routed(df, "body", schemas).collect()} == bodies
    assert routed(df.filter("1 = 0"), "body", schemas).count() == 0


def test_ratchet(spark):
    from sessionloom.plans import ratchet

    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    gap = lambda d, deadline="2024-01-05", owner="me": (d, "note", owner, deadline)
    runs = [
        ("c", day(1), True, [], [gap("D10")], 8, 100), ("c", day(2), False, ["D2", "D1"], [gap("D10"), gap("D11")], 7, 99), ("c", day(3), False, [], [gap("D10")], 8, 100), ("c", day(6), True, [], [gap("D10")], 8, 100), ("c", day(6, 1), False, [], [gap("D10")], 9, 100),
        ("c", day(7), False, [], [gap("D10", "soon"), gap("D9", "2024-02-30")], 8, 100), ("d", day(2), False, [], [], 1, 1), (None, day(2), False, [], [gap("D1", owner=None)], 1, 1),
    ]
    schema = "card string, run_at timestamp, accepted boolean, blocking array<string>, known_red array<struct<dimension:string,note:string,owner:string,deadline:string>>, class_count int, recall_percent int"
    got = {(r.card, r.run_at): (r.headline, r.passed, r.reasons.split("\n") if r.reasons else []) for r in ratchet.judged(spark.createDataFrame(runs, schema)).collect()}
    lacks = "KNOWN-RED lacks note, owner, or valid deadline"
    assert got == {
        ("c", day(1)): (ratchet.WITH_GAPS, True, []),
        ("c", day(2)): (ratchet.NOT_TRUSTED, False, ["D1 is BLOCKING-RED", "D2 is BLOCKING-RED", "KNOWN-RED count increased", "extended corpus class count shrank", "extended recall regressed"]),
        ("c", day(3)): (ratchet.WITH_GAPS, True, []),
        ("c", day(6)): (ratchet.WITH_GAPS, True, []),  # the day of grace ends here
        ("c", day(6, 1)): (ratchet.WITH_GAPS, False, ["D10 KNOWN-RED is past deadline"]),
        ("c", day(7)): (ratchet.WITH_GAPS, False, ["KNOWN-RED count increased", f"D10 {lacks}", f"D9 {lacks}"]),
        ("d", day(2)): (ratchet.TRUSTED, True, []),
        (None, day(2)): (ratchet.WITH_GAPS, False, [f"D1 {lacks}"]),
    }
    checks = spark.createDataFrame([("c", "D1", 0), ("c", "D2", 3), ("c", "D10", 1), ("e", "D10", 1)], "card string, dimension string, failures long")
    known = spark.createDataFrame([("c", "D10")], "card string, dimension string")
    assert {(r.card, r.dimension): r.state for r in ratchet.states(checks, known).collect()} == {("c", "D1"): "GREEN", ("c", "D2"): "BLOCKING-RED", ("c", "D10"): "KNOWN-RED", ("e", "D10"): "BLOCKING-RED"}
