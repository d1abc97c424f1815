"""Several tables written as one: staged first, then published by a single row.

A batch's tables are written below stages of their own. Only when all are
there, one row of the table of commits names the stage; readers join with that
table, so a batch that failed between two writes is not seen, and a replay
writes a new stage. A batch that is committed already is left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commits"


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, None if nothing is there yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def write_stage(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)


def is_committed(spark: SparkSession, root: str, batch: str) -> bool:
    done = _there(spark, f"{root}/{COMMITS}")
    return done is not None and not done.filter(F.col("batch") == batch).isEmpty()


def commit(tables: dict[str, DataFrame], root: str, batch: str) -> bool:
    """Write all ``tables`` or, to readers, none. False if ``batch`` had been committed before."""
    spark = next(iter(tables.values())).sparkSession
    if is_committed(spark, root, batch):
        return False
    stage = uuid.uuid4().hex
    for name, rows in tables.items():
        write_stage(rows, f"{root}/{name}/stage={stage}")
    spark.range(1).select(F.lit(batch).alias("batch"), F.lit(stage).alias("stage")).coalesce(1).write.mode("append").parquet(f"{root}/{COMMITS}")
    return True


def committed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Rows of a table whose batches are committed, None if it has none yet. Of a batch that two writers committed, the least stage counts."""
    rows, done = _there(spark, f"{root}/{name}"), _there(spark, f"{root}/{COMMITS}")
    if rows is None or done is None:
        return None
    stages = done.groupBy("batch").agg(F.min("stage").alias("stage"))  # a row a batch
    return rows.join(stages.select("stage"), "stage", "left_semi").drop("stage")
