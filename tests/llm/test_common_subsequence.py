"""Streams are aligned by a longest common subsequence whatever their length."""

import random

from sessionloom.llm.html_extract import _common


def _table(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    i = j = 0
    out = []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_pairs_are_those_of_the_table():
    rng = random.Random(5)
    for _ in range(400):
        x, y = ([rng.randrange(rng.choice((2, 5, 30))) for _ in range(rng.randrange(40))] for _ in range(2))
        assert list(_common(x, y)) == _table(x, y)


def test_long_streams_are_aligned_as_short_ones():
    rng = random.Random(7)
    x, y = ([rng.randrange(6) for _ in range(n)] for n in (1100, 1000))  # more than 2 ** 20 cells
    assert list(_common(x, y)) == _table(x, y)
