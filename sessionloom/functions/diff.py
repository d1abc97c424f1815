"""Line differences by longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def diff_lines(old: str, new: str) -> list[str]:
    """All lines, prefixed by a space, ``-`` or ``+``; of equally long ways deletions come first."""
    a, b = old.split("\n") if old else [], new.split("\n") if new else []
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    x, y = a[head:], b[head:]
    longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            longest[i][j] = longest[i + 1][j + 1] + 1 if x[i] == y[j] else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [" " + line for line in a[:head]], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(" " + x[i])
            i, j = i + 1, j + 1
        elif i < len(x) and (j == len(y) or longest[i + 1][j] >= longest[i][j + 1]):
            out.append("-" + x[i])
            i += 1
        else:
            out.append("+" + y[j])
            j += 1
    return out


@F.pandas_udf(T.StringType())
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(diff_lines(a or "", b or "")) for a, b in zip(old, new, strict=True)], dtype=object)
