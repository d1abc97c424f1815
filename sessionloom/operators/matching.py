"""Matching of rows by key, queue, time and multiplicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair_first_in_first_out(rows: DataFrame, keys: list[str], order: list[str], is_use: str) -> DataFrame:
    """Match each result with the oldest open use of its keys.

    ``rows`` holds uses and results (boolean column ``is_use``) in ``order``.
    Returns the rows with ``pair``: uses and results that belong together
    share keys and pair number; results without an open use have null, uses
    without a result have a number of their own. Running sums replace the
    queue: with the balance of uses over results, a result underflows just if
    the running minimum of the balance sinks to a new low.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col(is_use), 1).otherwise(-1)
    df = rows.withColumn("_balance", F.sum(step).over(upto))
    df = df.withColumn("_lost", F.greatest(F.lit(0), -F.min("_balance").over(upto)))
    df = df.withColumn("_lost_before", F.coalesce(F.lag("_lost").over(w), F.lit(0)))
    uses, results = (F.sum(F.when(c, 1).otherwise(0)).over(upto) for c in (F.col(is_use), ~F.col(is_use)))
    pair = F.when(F.col(is_use), uses).when(F.col("_lost") == F.col("_lost_before"), results - F.col("_lost"))
    return df.withColumn("pair", pair.cast("long")).drop("_balance", "_lost", "_lost_before")


def pair_by_id(uses: DataFrame, results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Results joined with the latest use of the same keys, each use at most once (the first result takes it).

    Columns of the use come as ``use_<name>``; a result without one has nulls.
    """
    one = uses.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter("_n = 1").drop("_n")
    one = one.select(*(F.col(c).alias(f"use_{c}") for c in one.columns))
    ranked = results.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    on = [F.col(k) == F.col(f"use_{k}") for k in keys] + [F.col("_n") == 1]
    return ranked.join(one, on, "left").drop("_n")


def last_after(events: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, tie: str) -> DataFrame:
    """Per key: the last row of ``events`` strictly after the key's mark (one row per key in ``marks``), latest ``tie`` among equals.

    ``marks`` is an aggregate, so the join keeps the partitioning by key and
    the as-of lookup is one more aggregate on it.
    """
    rest = [c for c in events.columns if c != key]
    after = events.join(marks.select(F.col(key).alias("_key"), F.col(mark_at).alias("_mark")), F.col(key) == F.col("_key")).filter(F.col(at) > F.col("_mark"))
    best = after.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_row"))
    return best.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def multiset_minus(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``left`` beyond as many as ``right`` has of the same keys, nulls equal; the first in ``order`` are taken away."""
    n = right.groupBy(*keys).agg(F.count("*").alias("_have"))
    n = n.select(*(F.col(k).alias(f"_r_{k}") for k in keys), "_have")
    on: list[Column] = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    ranked = left.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.join(n, on, "left").filter(F.col("_n") > F.coalesce("_have", F.lit(0))).select(*left.columns)


def first_writer(rows: DataFrame, key: str, order: list[str], out: str = "outcome") -> DataFrame:
    """``copied`` for the first row of a key, ``deduped`` for the others; ``order`` tells a key's rows apart.

    The first is an aggregate with partial sums, and rows are then joined with
    one row a key, so a key that many rows share is no group.
    """
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    joined = rows.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(out, F.when(F.struct(*order).eqNullSafe(F.col("_first")), "copied").otherwise("deduped")).select(*rows.columns, out)


def collision_suffix(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """The key for its first row; ``_2``, ``_3``, ... behind it for later ones."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn(out, F.when(n == 1, F.col(key)).otherwise(F.concat_ws("_", F.col(key), n.cast("string"))))
