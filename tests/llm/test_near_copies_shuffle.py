"""Sets of documents that no pair names are not shuffled, whatever the session's broadcast threshold."""

from sessionloom.llm import simhash


def test_unnamed_sketches_stay(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "k1 long, k2 long")
    sketches = spark.createDataFrame([(i, [i, i + 1]) for i in (1, 1, 2, 3, 4)], "key long, shingles array<int>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, joins in ((100, 1), (2, 0)):  # beyond the bound the keys are shuffled, with the same rows
            monkeypatch.setattr(simhash, "MEMBER_ROWS", most)
            out = simhash._beside(pairs, sketches, "shingles")
            assert (", LeftSemi, BuildRight" in out._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == bool(joins)
            assert sorted((r.k1, r.k2, r.v1, r.v2) for r in out.collect()) == [(1, 2, [1, 2], [2, 3]), (2, 3, [2, 3], [3, 4])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
