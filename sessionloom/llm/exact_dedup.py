"""Exact duplicates by skew-safe combining: locally, by salted digest groups, then globally.

1. *Local*: where a text is read, texts of one digest are compared in full and
   one row for each different text leaves the task: digest, the text without
   white space, the best row so far and a count. A group of copies of any size
   is now a row a buffer.
2. *Salted*: those rows meet by digest and salt, are compared in full again,
   and leave one winner for each different text.
3. *Global*: the salts' winners meet by digest and are compared once more.

Documents learn their class by digest from rows that were combined locally
first, so a hot class is a few rows in that join as well. Two texts of one
digest stay two classes at every stage; their documents find their class by
the text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_bytes

#: The characters that do not count, as bytes; none of them is part of another character in UTF-8.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of different texts, and rows, that a task combines before it passes them on.
BUFFER_BYTES, BUFFER_ROWS = 32 << 20, 1 << 16
#: Ways in which the rows of one digest are dealt.
SALTS = 16
#: Bytes of text for a partition of an exchange.
PART_BYTES = 64 << 20

_GROUPS = pa.schema([("digest", pa.binary()), ("salt", pa.int32()), ("content", pa.binary()), ("chars", pa.int64()), ("doc", pa.int64()), ("n", pa.int64())])
_MEMBERS = pa.schema([("digest", pa.binary()), ("sha", pa.binary()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("content", pa.binary())])


def _rank(chars: int, doc: int | None) -> tuple[int, bool, int]:
    """Least for the row that stays: the longest, then the smallest id, an id that is missing last."""
    return -chars, doc is None, doc or 0


def _combined_locally(digest_bytes: int, members: bool):
    """Rows (doc, text, chars) as groups of equal texts, a buffer at a time: as ``_GROUPS``, or with their ids as ``_MEMBERS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        shrink = zstandard.ZstdCompressor(level=1).compress
        held: dict[bytes, list[tuple[bytes, bytes, list, list]]] = {}
        size = rows = flushed = 0

        def out() -> pa.RecordBatch:
            each = [(digest, *g) for digest, own in held.items() for g in own]
            if members:
                cols = ([x[0] for x in each], [x[2] for x in each], [x[3] for x in each], [x[4] for x in each], [x[1] for x in each])
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MEMBERS, strict=True)], schema=_MEMBERS)
            best = [min(zip(x[4], x[3], strict=True), key=lambda cd: _rank(*cd)) for x in each]
            salt = (part + flushed) % SALTS
            cols = ([x[0] for x in each], [salt] * len(each), [shrink(x[1]) for x in each], [b[0] for b in best], [b[1] for b in best], [len(x[3]) for x in each])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _GROUPS, strict=True)], schema=_GROUPS)

        for batch in batches:
            for doc, text, chars in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                content = (text.as_py() or b"").translate(None, SPACE)
                sha = hashlib.sha256(content).digest()
                own = held.setdefault(sha[:digest_bytes], [])
                group = next((g for g in own if g[0] == content), None)
                if group is None:
                    own.append(group := (content, sha, [], []))
                    size += len(content)
                group[2].append(doc)
                group[3].append(chars)
                rows += 1
                if size > BUFFER_BYTES or rows >= BUFFER_ROWS:
                    yield out()
                    held.clear()
                    size, rows, flushed = 0, 0, flushed + 1
        if held:
            yield out()

    return run


def _same(a: bytes, b: bytes) -> bool:
    """Whether two packed texts are equal; equal bytes are, others are unpacked."""
    return a == b or zstandard.ZstdDecompressor().decompress(a) == zstandard.ZstdDecompressor().decompress(b)


def _merged(final: bool):
    """Rows sorted by digest: one for each different text, with the best row and the count of all.

    Finally with the number of texts that share the digest, and with the text only if there are more than one.
    """
    schema = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("chars", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("variants", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, own = None, []
        out: list[tuple] = []

        def close() -> None:
            for content, chars, doc, n in own:
                if final:
                    content = zstandard.ZstdDecompressor().decompress(content) if len(own) > 1 else None
                out.append((digest, content, chars, doc, n, len(own)))

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for new, content, chars, doc, n in zip(batch.column("digest").to_pylist(), batch.column("content"), *(batch.column(c).to_pylist() for c in ("chars", "doc", "n")), strict=True):
                content = content.as_py()
                if new != digest:
                    close()
                    digest, own = new, []
                    if len(out) >= 1000:
                        yield told()
                        out.clear()
                at = next((i for i, g in enumerate(own) if _same(g[0], content)), None)
                if at is None:
                    own.append((content, chars, doc, n))
                else:
                    best = min((own[at][1:3], (chars, doc)), key=lambda cd: _rank(*cd))
                    own[at] = (own[at][0], *best, own[at][3] + n)
        close()
        if out:
            yield told()

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Texts are equal when they are identical after deleting every character of
    ``[\\x20\\x09-\\x0D]``. Of equal ones the longest stays, then the one of the
    smallest id. A null text is empty; empty and blank texts are one class. A
    null id comes after all others. Rows that repeat the id and the length of
    the one that stays are that document: all of them are kept, and each row
    counts in ``group_size``. Other columns are not used, so their names can't
    clash. An empty table gives an empty result. Ids are integers.
    ``digest_bytes`` below 32 makes digests collide, for tests.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text_col) // PART_BYTES))
    local = rows.mapInArrow(_combined_locally(digest_bytes, False), "digest binary, salt int, content binary, chars long, doc long, n long")
    merged = "digest binary, content binary, chars long, doc long, n long, variants int"
    salted = local.repartition(parts, "digest", "salt").sortWithinPartitions("salt", "digest").mapInArrow(_merged(False), merged)
    whole = salted.repartition(parts, "digest").sortWithinPartitions("digest").mapInArrow(_merged(True), merged)
    classes = materialize(whole).select(F.col("digest").alias("c_digest"), F.col("content").alias("c_content"), F.col("doc").alias("keep_id"), F.col("chars").alias("keep_chars"), F.col("n").alias("group_size"), "variants")
    members = rows.mapInArrow(_combined_locally(digest_bytes, True), "digest binary, sha binary, docs array<long>, lengths array<long>, content binary")
    same = F.col("digest") == F.col("c_digest")
    told = members.drop("content").join(classes.filter("variants = 1").drop("c_content"), same)
    if not classes.filter("variants > 1").isEmpty():  # digests that several texts share: their documents are told by the text
        told = told.unionByName(members.join(classes.filter("variants > 1"), same & (F.col("content") == F.col("c_content"))).drop("content", "c_content"))
    each = told.select(F.explode(F.arrays_zip("docs", "lengths")).alias("m"), "keep_id", "keep_chars", "group_size", "sha")
    kept = F.col("m.docs").eqNullSafe(F.col("keep_id")) & (F.col("m.lengths") == F.col("keep_chars"))
    return each.select(F.col("m.docs").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_groups``."""
    stay = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("ed_id"), F.col("text_sha256").alias("ed_sha")).distinct()
    sha = F.sha2(F.regexp_replace(F.coalesce(text_col, F.lit("")), "[\\x20\\x09-\\x0D]", ""), 256)
    longest = F.col(id_col).cast("long").eqNullSafe(F.col("ed_id")) & (sha == F.col("ed_sha"))
    return docs.join(stay, longest, "left_semi")
