"""Gates: rows that may not pass are set aside with the reason, or fail the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


class Refused(ValueError):
    """A gate in failing mode met a row that may not pass."""


def split(rows: DataFrame, problem: Column, fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows without a problem, rows with one and ``problem``). With ``fail`` the first problem, in the order of the first column, is raised."""
    judged = written(rows.withColumn("problem", problem))
    bad = judged.filter("problem IS NOT NULL")
    if fail and (first := bad.orderBy(rows.columns[0], "problem").first()) is not None:
        raise Refused(f"{first[0]}: {first['problem']}")
    return judged.filter("problem IS NULL").drop("problem"), bad


def context(parts: dict[str, DataFrame], key: str = "session_id", fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parts of the same things joined by ``key``: (complete ones, others with ``problem``).

    A thing is complete if every part has exactly one row of it; columns besides
    the key come as ``<part>_<column>``. The problem names each part that is
    missing or repeated, in the order of ``parts``. A key that is null is a thing
    of its own. Rows are counted first, so a repeated key is no group in a task.
    """
    counts = [rows.groupBy(F.col(key).alias(key)).agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, rows in parts.items()]
    per = reduce(DataFrame.unionByName, counts).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("n"))
    said = F.array_compact(F.array(*(F.when(F.col("n")[name].isNull(), f"{name} is missing").when(F.col("n")[name] > 1, f"{name} is repeated") for name in parts)))
    judged = per.select(key, F.when(F.size(said) > 0, F.array_join(said, ", ")).alias("said"))
    good, bad = split(judged.select(key, "said"), F.col("said"), fail)
    whole = good.select(key)
    for name, rows in parts.items():
        own = rows.select(*(F.col(c).alias(f"{name}_{c}") for c in rows.columns))
        whole = whole.join(own, F.col(key).eqNullSafe(F.col(f"{name}_{key}"))).drop(f"{name}_{key}")
    return whole, bad.select(key, "problem")


def only(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The one row whose key is ``value``; none or several are refused."""
    found = rows.filter(F.col(key) == value.strip())
    n = found.limit(2).count()
    if n != 1:
        raise Refused(f"{key} {value!r} " + ("not found" if n == 0 else "is there twice or more"))
    return found
