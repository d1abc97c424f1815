"""Content-addressed stores: verified, merged, and read in place of live files that have changed or gone.

A store has blobs (digest, content). A digest is the SHA-256 of the content in
lower-case hexadecimal; nothing is taken on trust: what is read is hashed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commands import is_hex_digest
from ..functions.text import quoted
from .vault import blob_path

PREFIX = "sha256:"


def digest_of(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def blob_problem(digest: Column, content: Column) -> Column:
    """Why a blob can't be what its digest says, null if it is."""
    return F.when(~F.coalesce(is_hex_digest(digest), F.lit(False)), "digest is not 64 lower-case hexadecimal digits").when(content.isNull(), "content missing").when(digest_of(content) != digest, "content does not match digest")


def merged(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs of both stores, one a digest, with ``origin``; unsound blobs with ``origin`` and ``problem``).

    A digest that both have is taken from the first; one whose blob there is
    unsound from the second. Merging a store with itself, or again with what has been
    merged, changes nothing. Repeated rows count once: contents of one digest are
    the same once they are verified. Contents move only where digests meet.
    """
    both = first.select("digest", "content", F.lit(1).alias("origin")).unionByName(second.select("digest", "content", F.lit(2).alias("origin"))).withColumn("problem", blob_problem(F.col("digest"), F.col("content")))
    sound = both.filter("problem IS NULL")
    took = sound.groupBy(F.col("digest").alias("t_digest")).agg(F.min("origin").alias("t_origin"))
    kept = sound.join(took, (F.col("digest") == F.col("t_digest")) & (F.col("origin") == F.col("t_origin"))).dropDuplicates(["digest"])
    return kept.select("digest", "content", "origin"), both.filter("problem IS NOT NULL").select("digest", "origin", "problem")


def upserted(refs: DataFrame, new: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(refs with new ones, refused ones with ``problem``): the first writer of a raw_id wins, the same digest again is no news, another one is an error.

    Both have raw_id, digest and further columns; ``order`` says which of several new rows of an id came first.
    """
    known = refs.select(F.col("raw_id").alias("k_id"), F.col("digest").alias("k_digest")).dropDuplicates(["k_id"])
    first = new.groupBy(F.col("raw_id").alias("f_id")).agg(F.min(F.struct(*order, "digest")).alias("f"))
    seen = new.join(known, F.col("raw_id") == F.col("k_id"), "left").join(first, F.col("raw_id") == F.col("f_id"))
    holder = F.coalesce("k_digest", F.col("f.digest"))
    judged = seen.withColumn("problem", F.when(~F.col("digest").eqNullSafe(holder), F.concat(F.lit("raw ref "), "raw_id", F.lit(" is of digest "), holder, F.lit(", not "), F.coalesce("digest", F.lit("-")))))
    fresh = judged.filter(F.col("k_id").isNull() & F.struct(*order, "digest").eqNullSafe(F.col("f"))).select(*new.columns).dropDuplicates(["raw_id"])
    return refs.unionByName(fresh), judged.filter("problem IS NOT NULL").select(*new.columns, "problem")


def transcript_bytes(events: DataFrame, live: DataFrame, blobs: DataFrame) -> DataFrame:
    """``events`` (transcript_path, digest: ``sha256:...`` or blank) with ``content``, ``origin`` (live or blob) and ``problem``.

    The live file (path, content) is read if it is what was captured, or if
    nothing was; else the blob of the captured digest, whose bytes are hashed
    again before they are believed.
    """
    files = live.select(F.col("path").alias("l_path"), F.col("content").alias("l_content"), digest_of(F.col("content")).alias("l_digest")).dropDuplicates(["l_path"])
    given = F.trim(F.coalesce("digest", F.lit("")))
    bare = F.when(given.startswith(PREFIX), F.substring(given, len(PREFIX) + 1, 100))
    held = blobs.select(F.col("digest").alias("b_digest"), F.col("content").alias("b_content")).dropDuplicates(["b_digest"])
    df = events.withColumn("bare", bare).join(files, F.col("transcript_path") == F.col("l_path"), "left")
    there = F.col("l_path").isNotNull()
    use_live = there & (F.coalesce(F.col("l_digest") == F.col("bare"), F.lit(False)) | (given == ""))
    # rows that want no blob get keys of their own, which no digest equals: nulls would meet in one task
    wanted = F.coalesce(F.when(~use_live, F.col("bare")), F.concat(F.lit("-"), F.xxhash64(*events.columns).cast("string")))
    df = df.withColumn("wanted", wanted).join(held, F.col("wanted") == F.col("b_digest"), "left")
    problem = (
        F.when(use_live, F.lit(None))
        .when(F.col("bare").isNull() & ~there, F.concat(F.lit("missing transcript "), "transcript_path"))
        .when(F.col("bare").isNull(), "live transcript unavailable and event has no vault blob digest")
        .when(F.length("bare") < 2, F.concat(F.lit("event raw digest "), quoted(given), F.lit(" is invalid")))
        .when(F.col("b_digest").isNull(), F.concat(F.lit("no blob "), blob_path(F.col("bare"))))
        .when(digest_of(F.col("b_content")) != F.col("bare"), F.concat(F.lit("blob "), blob_path(F.col("bare")), F.lit(" does not match its digest")))
    )
    df = df.withColumns({"problem": problem, "use_live": use_live})
    content = F.when(F.col("problem").isNull(), F.when(F.col("use_live"), F.col("l_content")).otherwise(F.col("b_content")))
    return df.select(*events.columns, content.alias("content"), F.when(F.col("problem").isNull(), F.when(F.col("use_live"), "live").otherwise("blob")).alias("origin"), "problem")
