"""Repeated strings whose anchor is very frequent, over many blocks."""

import random


def test_strings_of_hot_anchors_repeat_across_blocks(spark, monkeypatch):
    from sessionloom.llm import suffix_dedup as S

    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage, edge = noise(150), noise(150)
    texts = [noise(120) + passage + noise(120) for _ in range(60)]  # the passage alone is shorter than a string
    texts += [noise(120) + passage + edge + noise(90) for _ in range(2)] + [noise(90) + edge + passage + noise(60) for _ in range(3)]
    dealt = S.in_blocks
    monkeypatch.setattr(S, "in_blocks", lambda docs, block, *cols: dealt(docs, block, *cols, 500))
    monkeypatch.setattr(S, "HOT", 10)
    count = {}
    for t in texts:
        for p in range(len(t) - 199):
            count[t[p : p + 200]] = count.get(t[p : p + 200], 0) + 1
    want = {}
    for i, t in enumerate(texts):
        gone = {q for p in range(len(t) - 199) if count[t[p : p + 200]] > 1 for q in range(p, p + 200)}
        want[i] = "".join(c for q, c in enumerate(t) if q not in gone)
    assert sum(want[i] != t for i, t in enumerate(texts)) == 5
    out = S.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: bytes(r.kept_bytes).decode() for r in out} == want
