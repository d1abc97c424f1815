"""A vault's life: files archived under a kind, raw content erased on request, backups by consent, a status; links to artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commands import is_hex_digest
from ..functions.text import blank_to, quoted
from ..operators.matching import first_writer
from .artifacts import ARTIFACTS
from .contracts import RECEIPT_VERSION, SCHEMAS
from .quality import schema_violations
from .store import digest_of
from .vault import KINDS, MAX_BLOB, blob_path, source_of

RECEIPTS, METADATA = "memory_import_receipt", "source_metadata"
RAW_ID = "raw_"


def receipt_problem(text: Column) -> Column:
    """Why a receipt may not be archived, null if it may: it must meet its contract and not be of a forbidden namespace."""
    broken = schema_violations(F.try_parse_json(text), SCHEMAS[RECEIPT_VERSION][1])
    first = F.concat(F.lit("invalid memory import receipt: "), F.get(broken, F.lit(0)))
    return F.coalesce(first, F.when(F.get_json_object(text, "$.error_class") == "namespace_forbidden", "memory import receipt has namespace_forbidden and is not archived"))


def archived(files: DataFrame, refs: DataFrame, kind: str = METADATA) -> DataFrame:
    """``files`` (path, content) with raw_id, digest, source, kind, size, blob_path, outcome (archived, deduped or refused), warning and problem.

    A digest that ``refs`` (digest) or a file of lesser path has is deduped.
    Receipts are judged when they are archived as such; elsewhere one that
    looks like it gives a warning, as its kind is not pinned.
    """
    if kind not in KINDS:
        raise ValueError(f"unsupported raw kind {kind!r}")
    text = F.col("content").cast("string")
    problem = F.when(F.col("content").isNull(), "content missing").when(F.octet_length("content") > MAX_BLOB, "content too large")
    if kind == RECEIPTS:
        problem = F.coalesce(problem, receipt_problem(text))
    shaped = F.coalesce(F.get_json_object(text, "$.schema_version") == RECEIPT_VERSION, F.lit(False)) if kind == METADATA else F.lit(False)
    df = files.withColumns({
        "problem": problem, "digest": digest_of(F.col("content")), "size": F.octet_length("content").cast("long"), "source": source_of(F.col("path")), "kind": F.lit(kind),
        "warning": F.when(shaped, f"receipt-shaped input archived as {METADATA}; its kind is not pinned"),
    })
    df = first_writer(df.withColumn("own", F.when(F.col("problem").isNull(), F.col("digest"))), "own", ["path"])  # refused ones have no digest to take
    known = refs.select(F.col("digest").alias("k_digest")).distinct()
    outcome = F.when(F.col("problem").isNotNull(), "refused").when((F.col("outcome") == "copied") & F.col("k_digest").isNull(), "archived").otherwise("deduped")
    whole = df.join(known, F.col("own") == F.col("k_digest"), "left").withColumn("outcome", outcome).drop("k_digest", "own")
    return whole.withColumns({"raw_id": F.concat(F.lit(RAW_ID), "digest"), "blob_path": blob_path(F.col("digest"))})


def erased(requests: DataFrame, refs: DataFrame, blobs: DataFrame, erased_at: str) -> tuple[DataFrame, DataFrame]:
    """(tombstones: raw_ref_id, digest, reason, erased_at, blob_removed; refused requests with ``problem``).

    ``requests`` has raw_ref_id and reason. Tombstones are written before blobs
    are taken away (``vault.without_tombstoned``), so what fails between is still known as
    erased; ``blob_removed`` says that there was a blob to take. Of several
    requests for one ref the least reason counts.
    """
    asked = requests.select(F.trim(F.coalesce("raw_ref_id", F.lit(""))).alias("raw_ref_id"), F.trim(F.coalesce("reason", F.lit(""))).alias("reason"))
    hexed = F.when(F.col("raw_ref_id").startswith(RAW_ID), F.substring("raw_ref_id", len(RAW_ID) + 1, 1000))
    have = refs.select(F.col("raw_ref_id").alias("r_id"), F.col("digest").alias("r_digest")).dropDuplicates(["r_id"])
    there = blobs.select(F.col("digest").alias("b_digest")).distinct()
    df = asked.withColumn("hexed", hexed).join(have, F.col("raw_ref_id") == F.col("r_id"), "left").join(there, F.col("r_digest") == F.col("b_digest"), "left")
    problem = (
        F.when(F.col("raw_ref_id") == "", "missing raw_ref_id")
        .when(F.col("reason") == "", "missing erasure reason")
        .when(~F.coalesce(is_hex_digest(F.col("hexed")), F.lit(False)), F.concat(F.lit("invalid raw_ref_id "), quoted(F.col("raw_ref_id"))))
        .when(F.col("r_id").isNull(), F.concat(F.lit("no raw ref "), "raw_ref_id"))
    )
    df = df.withColumn("problem", problem)
    stones = df.filter("problem IS NULL").groupBy("raw_ref_id", F.col("r_digest").alias("digest")).agg(F.min("reason").alias("reason"), F.bool_or(F.col("b_digest").isNotNull()).alias("blob_removed"))
    return stones.withColumn("erased_at", F.lit(erased_at)), df.filter("problem IS NOT NULL").select("raw_ref_id", "reason", "problem")


def backed_up(files: DataFrame, copies: DataFrame, consents: DataFrame) -> DataFrame:
    """A backup of each vault: vault, destination, file_count, raw_egress, audited, verified, problem.

    ``files`` (vault, path, content) are what is to be saved, ``copies`` (vault,
    path, content) what the destination holds afterwards, ``consents`` (vault, destination,
    allow_raw). Raw content leaves only by consent, which is audited; a
    backup is verified if every file is there with the same bytes and nothing
    else is. A vault without consent is refused and nothing of it counts as copied.
    """
    raw = F.col("path").startswith("raw/")
    have = files.select("vault", "path", digest_of(F.col("content")).alias("digest"), raw.alias("raw"))
    there = copies.select(F.col("vault").alias("c_vault"), F.col("path").alias("c_path"), digest_of(F.col("content")).alias("c_digest"))
    both = have.join(there, (F.col("vault") == F.col("c_vault")) & (F.col("path") == F.col("c_path")), "full")
    per = both.groupBy(F.coalesce("vault", "c_vault").alias("v")).agg(
        F.count("vault").alias("files"), F.coalesce(F.bool_or("raw"), F.lit(False)).alias("raw_egress"), F.bool_and(F.coalesce(F.col("digest").eqNullSafe(F.col("c_digest")) & F.col("vault").isNotNull() & F.col("c_vault").isNotNull(), F.lit(False))).alias("same")
    )
    df = consents.join(per, F.col("vault") == F.col("v"), "left").withColumns({"raw_egress": F.coalesce("raw_egress", F.lit(False)), "files": F.coalesce("files", F.lit(0)), "destination": F.trim(F.coalesce("destination", F.lit("")))})
    problem = F.when(F.col("destination") == "", "missing backup destination").when(F.col("destination") == F.col("vault"), "backup destination must differ from the vault").when(F.col("raw_egress") & ~F.coalesce("allow_raw", F.lit(False)), "backup includes raw vault bytes; confirm that the destination is approved")
    done = problem.isNull()
    return df.select(
        "vault", "destination", F.when(done, F.col("files")).otherwise(0).alias("file_count"), (done & F.col("raw_egress")).alias("raw_egress"), F.when(done & F.col("raw_egress"), F.to_json(F.struct(F.lit("raw_egress_ack").alias("event"), "destination"))).alias("audit"),
        (done & F.coalesce("same", F.lit(True))).alias("verified"), problem.alias("problem"),
    )


def status(blobs: DataFrame, refs: DataFrame, states: DataFrame) -> DataFrame:
    """(vault, home_state, vault_blobs, vault_refs, last_backfill_at, copy_failures): what each vault of ``states`` (vault, last_backfill_at, copy_failures) holds; missing, with zeros, if it holds nothing. ``blobs`` and ``refs`` have vault and digest."""
    count = lambda df, name: df.groupBy(F.col("vault").alias(f"v_{name}")).agg(F.count_distinct("digest").alias(name))
    df = states.join(count(blobs, "vault_blobs"), F.col("vault") == F.col("v_vault_blobs"), "left").join(count(refs, "vault_refs"), F.col("vault") == F.col("v_vault_refs"), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return df.select("vault", F.when(n("vault_blobs") + n("vault_refs") > 0, "present").otherwise("missing").alias("home_state"), n("vault_blobs").alias("vault_blobs"), n("vault_refs").alias("vault_refs"), blank_to(F.col("last_backfill_at"), "-").alias("last_backfill_at"), n("copy_failures").alias("copy_failures"))


def first_time(*times: Column) -> Column:
    """The first of several times that isn't blank, as it is; null if all are."""
    return F.coalesce(*(F.when(F.trim(t) != "", t) for t in times))


def links(made: DataFrame, created: DataFrame) -> DataFrame:
    """Links to the artifacts that others may see: artifact_id, session_id, type, label, media_type, href, digest, created_at. ``created`` has session_id and created_at."""
    look = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in ARTIFACTS.items() for x in (k, v[i]))), F.col("artifact"))
    shown = made.filter(F.col("artifact").isin(*(a for a, v in ARTIFACTS.items() if v[3])))
    at = created.select(F.col("session_id").alias("c_id"), "created_at")
    return shown.join(at, F.col("session_id") == F.col("c_id"), "left").select(F.concat_ws(":", "session_id", "artifact").alias("artifact_id"), "session_id", F.col("artifact").alias("type"), look(2).alias("label"), look(1).alias("media_type"), F.col("path").alias("href"), "digest", "created_at")
