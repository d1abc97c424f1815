import os

import pytest

SF = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore "


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, names that clash with the operators' own."""
    shared = "This Shared Line is long enough to be counted by every document here"
    rows = [
        (1, "", "en", 0, "x"),
        (2, None, None, None, None),
        (3, " \n\t\n", "en", 1, "x"),
        (None, f"an id is missing here\n{shared}", "fr", 2, "y"),
        (5, f"first of two equal rows\n{shared}\n{shared.upper()}", "en", 3, "y"),
        (5, f"first of two equal rows\n{shared}\n{shared.upper()}", "en", 3, "y"),
        (6, f"{shared}  \nnaïve café ▁ 漢字 😀 &amp; <b>", "de", 4, "z"),
        (7, LONG * 400 + "\n" + shared, "en", 5, "z"),
        (8, LONG * 400 + "\n" + shared, "en", 5, "z"),
        (9, "short", "en", 6, "z"),
        (-4, shared, "en", 7, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_dropped long, block string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("1 = 0")


@pytest.fixture(scope="session", params=["odd", "table"])
def some_docs(request, spark, odd_docs):
    """The odd documents, and the smallest of the given tables as the registered queries read it."""
    if request.param == "odd":
        return odd_docs
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return spark.read.parquet(f"{SF}/documents.parquet")
