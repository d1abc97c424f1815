"""Leak markers of any number of words against plain containment."""


def test_markers_without_an_inner_word(spark):
    from sessionloom.plans.quality import leaks

    texts = [(1, "the needle is here"), (2, "pinneedles and two words"), (3, "nothing"), (4, None), (None, "one two  three four"), (None, "a needle again"), (7, "one two three four")]
    marks = [("a", "needle"), ("b", "two words"), ("c", "two three four"), ("d", " "), ("e", ""), ("f", "e two t"), ("g", "two  t"), ("a", "nothing"), (None, "four")]
    want = {(t, m) for t, x in texts for m, y in marks if x and y and y in x}
    out = leaks(spark.createDataFrame(texts, "t long, x string"), spark.createDataFrame(marks, "m string, y string"), "t", "x", "m", "y").collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want
