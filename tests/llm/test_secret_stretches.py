"""Weak parts longer than a stretch."""


def test_weak_part_of_many_stretches_meets_its_complement_at_its_end(spark):
    from sessionloom.llm.secret_scan import KINDS, STRETCH, mask_secrets, secret_spans

    blob = "aB3d" * STRETCH  # four stretches
    tail = "x " * STRETCH
    texts = [
        f"{tail[:100]}{blob} client_id=web-7",  # the complement is in the last stretch only
        f"client_id=web-7 {blob} {tail}",
        f"{blob} {tail} client_id=web-7",
        f"client_id=web-7 {blob}0123456789abcdef01234567890 soon",  # a base span at its end covers it
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [KINDS[s.kind] for s in r.spans] for r in secret_spans(docs).collect()}
    assert found == {0: ["secret", "ident"], 1: ["ident", "secret"], 2: [], 3: ["ident", "hex"]}
    masked = {r.doc_id: r.text for r in mask_secrets(docs).collect()}
    assert masked[0] == f"{tail[:100]}[secret] [ident]" and masked[2] == texts[2]


def test_many_secrets_of_a_long_text_are_masked(spark):
    """Spans in and across pieces, overlapping ones joined; time in proportion to the text."""
    import random
    import time

    from sessionloom.llm.secret_scan import mask_secrets

    rng = random.Random(3)
    parts, want = [], []
    for i in range(20_000):
        gap = "é😀word " * rng.randint(1, 8)
        parts += [gap, "AKIA" + "Q" * 18 + " "]
        want += [gap, "[access] "]
    both = "token=" + "a1" * 16  # an assignment and a hexadecimal run in one
    docs = spark.createDataFrame([(1, "".join(parts)), (2, both + " end"), (3, "é" * 2047 + both), (4, "none"), (5, "")], "doc_id long, text string")
    start = time.perf_counter()
    out = {r.doc_id: r.text for r in mask_secrets(docs).collect()}
    assert time.perf_counter() - start < 120
    assert out[1] == "".join(want)
    assert out[2] == "[assign] end" and out[3] == "é" * 2047 + "[assign]" and out[4] == "none" and out[5] == ""
