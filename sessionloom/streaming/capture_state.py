"""What a vault knows of its captures, kept as a stream's state: last capture, missing and failed counts.

Events arrive in any split into batches. A vault's state is ``SALTS`` rows, dealt
by a hash of the event, so a vault with most of all events is no group of one
task, and state grows with the number of vaults only. After each batch the
stream gives the rows that changed; the latest of each together are a vault's
state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Rows of state for a vault.
SALTS = 16
COUNTS = ("captured", "raw_missing", "copy_failures")
STATE = "last_capture_at string, captured long, raw_missing long, copy_failures long, version long"
OUT = f"vault string, salt int, {STATE}"
EMPTY = ("", 0, 0, 0, 0)


class Captures(StatefulProcessor):
    """Per vault and salt: the greatest time, and counts of events by outcome."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("captures", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        last, captured, missing, failed, version = self.state.get() if self.state.exists() else EMPTY
        for batch in rows:
            last = max(last, batch["at"].dropna().max() if batch["at"].notna().any() else "")
            captured += len(batch)
            missing, failed = missing + int((batch["outcome"] == "missing").sum()), failed + int((batch["outcome"] == "failed").sum())
        now = (last, captured, missing, failed, version + 1)
        self.state.update(now)
        yield pd.DataFrame([(*key, *now)], columns=["vault", "salt", "last_capture_at", *COUNTS, "version"])

    def close(self) -> None:
        pass


def drain_captures(spark: SparkSession, spool: str, out: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Take up what is new in a folder of JSON lines (vault, event_id, at, outcome) and append the states that changed to the table ``out``.

    State is kept by the RocksDB provider in the checkpoint folder; a second
    drain goes on from it.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    reader = spark.readStream.schema("vault string, event_id string, at string, outcome string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    salt = F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int")
    states = reader.json(spool).withColumn("salt", salt).groupBy("vault", "salt").transformWithStateInPandas(statefulProcessor=Captures(), outputStructType=OUT, outputMode="Update", timeMode="None")

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    states.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def capture_states(states: DataFrame) -> DataFrame:
    """The state of each vault, blank time if it never captured; a batch that was written twice says the same twice."""
    latest = states.groupBy("vault", "salt").agg(F.max_by(F.struct("last_capture_at", *COUNTS), "version").alias("s")).select("vault", "s.*")
    return latest.groupBy("vault").agg(F.max("last_capture_at").alias("last_capture_at"), *(F.sum(c).alias(c) for c in COUNTS))
