"""The pipeline's stages, each on what the one before kept, against brute force."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar(a, b):
    return a == b or bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def components(sets):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and similar(a, sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_similar_groups_against_brute_force(spark):
    """Texts with ever more words exchanged: links are exact, nearly all pairs at 0.8 and above are found."""
    import random

    from sessionloom.llm.simhash import similar_groups

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(5))
    texts = [None, "", "  ", "two words", "Two  words", "one"]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([40, 150, 400]))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for at in rng.sample(range(len(own)), int(len(own) * rng.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.1]))):
                own[at] = word()
            texts.append(" ".join(own))
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, texts[-1], 0), (3, "two words", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out, links = similar_groups(df)
    sets = [shingles(t) for t in texts]
    root = components(sets)
    got = {r.doc_id: r.component_id for r in out.collect() if r.doc_id is not None}
    assert out.columns == ["doc_id", "text", "component_id"] and out.count() == len(rows)
    assert all(root[got[i]] == root[i] for i in got)  # nothing is in a group that brute force doesn't make
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs) > 100
    assert all(r.similarity >= 0.8 for r in links.collect())
    assert similar_groups(df.filter("1 = 0"))[0].count() == 0


def test_table_plans():
    from sessionloom.llm.simhash import table_plan

    plans = [table_plan(n, 0.8) for n in (0, 1000, 2 * 10**5, 10**7, 10**9)]
    assert [p[0] for p in plans] == sorted(p[0] for p in plans) and plans[0][0] == 32
    assert all(0.1 < share < 0.2 and tables >= 20 for _, tables, share in plans)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    import corpus_pipeline as P
    from sessionloom.llm.quality_rules import quality_report
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_copies", "secrets", "packing"]
    stage = dict(P.STAGES)
    good = stage["quality"](spark, docs, SF).cache()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality_report(docs, labels).collect() if r.kept}
    lined = stage["lines"](spark, good, SF).cache()
    assert lined.columns == docs.columns and lined.count() == good.count()
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    unique = stage["near_copies"](spark, lined, SF).cache()
    rows = sorted(((r.doc_id, shingles(r.text)) for r in lined.collect()), key=lambda r: r[0])
    kept = {r.doc_id for r in unique.collect()}
    root = components([s for _, s in rows])
    want = {i for k, (i, _) in enumerate(rows) if root[k] == k}
    assert want <= kept and len(kept - want) <= 0.05 * len(rows)  # no more than the similar go; nearly all of those do
    safe = stage["secrets"](spark, unique, SF).cache()
    assert safe.columns == docs.columns and safe.count() == unique.count()
    assert safe.filter(r"text rlike 'AKIA[A-Z0-9]{16}' OR text rlike '[0-9a-f]{24}'").count() == 0
    packed = stage["packing"](spark, safe, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in safe.collect()}
    assert packed.count() == P.run(spark, SF).count()
