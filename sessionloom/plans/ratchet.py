"""A scorecard that may only get better: executed dimensions, named gaps with deadlines, and the last accepted run to compare with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# States, headlines, reasons.
GREEN, KNOWN_RED, BLOCKING_RED = "GREEN", "KNOWN-RED", "BLOCKING-RED"
TRUSTED, WITH_GAPS, NOT_TRUSTED = "TRUSTED", "TRUSTED-WITH-NAMED-GAPS", "NOT-TRUSTED"
#: A deadline holds until this many hours after its date begins.
GRACE_HOURS = 24


def states(checks: DataFrame, known: DataFrame) -> DataFrame:
    """``checks`` (card, dimension, failures) with ``state``: green without failures, known red if the failing dimension is a named gap of ``known`` (card, dimension), else blocking. A named gap is shown red even if its check passes."""
    named = known.select(F.col("card").alias("k_card"), F.col("dimension").alias("k_dimension")).distinct()
    df = checks.join(named, F.col("card").eqNullSafe(F.col("k_card")) & (F.col("dimension") == F.col("k_dimension")), "left")
    state = F.when(F.col("k_dimension").isNotNull(), KNOWN_RED).when(F.col("failures") > 0, BLOCKING_RED).otherwise(GREEN)
    return df.withColumn("state", state).drop("k_card", "k_dimension")


def past_deadline(deadline: Column, now: Column) -> Column:
    """Whether ``now`` is later than a day after the date ``deadline`` (yyyy-MM-dd) begins; null if it is no date."""
    date = F.when(deadline.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(deadline, F.lit("yyyy-MM-dd")))
    return now > date + F.make_interval(hours=F.lit(GRACE_HOURS))


def judged(runs: DataFrame) -> DataFrame:
    """``runs`` with ``headline``, ``passed`` and ``reasons`` (LF-joined, in order).

    A run has card, run_at (timestamp), accepted, blocking (array of
    dimensions), known_red (array of dimension, note, owner, deadline),
    class_count and recall_percent. It is compared with the card's latest
    accepted run before it; a card without one has no baseline and can't
    regress.
    """
    before = W.partitionBy("card").orderBy("run_at").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("accepted"), F.struct(F.size("known_red").alias("reds"), "class_count", "recall_percent")), ignorenulls=True).over(before)
    df = runs.withColumn("_last", last)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""

    def gap(x: Column) -> Column:
        late = past_deadline(x["deadline"], F.col("run_at"))
        return F.when(blank(x["note"]) | blank(x["owner"]) | late.isNull(), F.concat(x["dimension"], F.lit(" KNOWN-RED lacks note, owner, or valid deadline"))).when(late, F.concat(x["dimension"], F.lit(" KNOWN-RED is past deadline")))

    reasons = F.array_compact(F.concat(
        F.transform(F.array_sort("blocking"), lambda x: F.concat(x, F.lit(" is BLOCKING-RED"))),
        F.array(F.when(F.size("known_red") > F.col("_last.reds"), "KNOWN-RED count increased")),
        F.transform(F.array_sort("known_red"), gap),
        F.array(F.when(F.col("class_count") < F.col("_last.class_count"), "extended corpus class count shrank"), F.when(F.col("recall_percent") < F.col("_last.recall_percent"), "extended recall regressed")),
    ))
    headline = F.when(F.size("blocking") > 0, NOT_TRUSTED).when(F.size("known_red") > 0, WITH_GAPS).otherwise(TRUSTED)
    return df.withColumns({"headline": headline, "_reasons": reasons}).withColumns({"passed": F.size("_reasons") == 0, "reasons": F.array_join("_reasons", "\n")}).drop("_last", "_reasons")
