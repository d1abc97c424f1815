"""Line dedup through sharded minimal perfect hashes.

Every eligible line key (stripped, ASCII lower case, at least ``min_chars``
code points) gets a 128-bit hash. Per shard of the hash space, a minimal
perfect hash over the distinct keys indexes three compact arrays: a 64-bit
fingerprint, the number of documents and the largest doc_id holding the key.
Blocks of documents send each distinct key once to its shard, which probes
its arrays and answers only with keys in at least ``min_docs`` documents; the
block then drops lines. Lines are never joined with lines and nothing is
broadcast. Blocks ask in groups of ``ASKING``, each of which has arrays of its
own for the keys it asks for, so a line that every block holds brings at most
that many requests into a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BLOCK_BYTES, fresh, in_blocks, n_blocks

#: ASCII white space of a key's ends: U+0020 and U+0009-U+000D.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of text for each shard of the hash space.
SHARD_BYTES = 32 << 20
#: Blocks whose requests meet in one group.
ASKING = 4096
NO_DOC = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None if it is shorter than ``min_chars`` code points."""
    key = line.strip(BLANKS)
    if len(key) < min_chars:
        return None
    key = key.lower()
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _hash(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys by levels of collision-free bits.

    At each level a key takes the bit its hash names if no other key left
    names the same one; the others go on. A key's index is the number of set
    bits before its own.
    """

    GAMMA = 1.7

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        total, left = 0, keys.astype(np.uint64)
        while len(left):
            size = max(64, int(len(left) * self.GAMMA))
            at = (_mix(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(at, minlength=size) == 1
            rank = total + np.cumsum(taken) - taken
            self.levels.append((taken, rank))
            total += int(taken.sum())
            left = left[~taken[at]]
            if len(self.levels) > 200:
                raise ValueError("keys are not distinct")
        self.size = total

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for some keys outside the set (others get a wrong index, which the fingerprint tells)."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (taken, rank) in enumerate(self.levels):
            if not len(todo):
                break
            at = (_mix(keys[todo], level) % np.uint64(len(taken))).astype(np.int64)
            hit = taken[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return out


def _keys_of(min_chars: int, id_at: str, text_at: str, block: str):
    def run(batches):
        for batch in batches:
            found: dict[tuple[int, bytes], list[int]] = {}
            for doc, text, blk in zip(batch.column(id_at).to_pylist(), batch.column(text_at), batch.column(block).to_pylist(), strict=True):
                if (text := text.as_py()) is None:
                    continue
                doc = NO_DOC if doc is None else doc
                for key in {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}:
                    got = found.setdefault((blk, xxhash.xxh3_128_digest(key)), [0, NO_DOC])
                    got[0] += 1
                    got[1] = max(got[1], doc)
            h = np.frombuffer(b"".join(k[1] for k in found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())],
                ["blk", "h1", "h2", "n", "top"],
            )

    return run


def _probe(min_docs: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:  # a side without rows has no columns either
            return _ANSWER.empty_table()
        h1, h2 = (index.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2"))
        # two keys that agree in the first 64 bits are told apart by xoring in the second
        mph = PerfectHash(_slot(h1, h2))
        order = mph(_slot(h1, h2))
        prints, counts, tops = np.empty(mph.size, np.int64), np.empty(mph.size, np.int64), np.empty(mph.size, np.int64)
        prints[order], counts[order], tops[order] = h2, index.column("n").to_numpy(), index.column("top").to_numpy()
        a1, a2 = (asked.column(c).to_numpy().astype(np.int64) for c in ("a1", "a2"))
        at = mph(_slot(a1, a2))
        ok = np.zeros(len(at), bool)
        ok[at >= 0] = (prints[at[at >= 0]] == a2[at >= 0]) & (counts[at[at >= 0]] >= min_docs)
        return pa.table({"blk": asked.column("blk").to_numpy()[ok], "h1": a1[ok], "h2": a2[ok], "top": tops[at[ok]]}, _ANSWER)

    return run


def _slot(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1.view(np.uint64) ^ _mix(h2.view(np.uint64), 7)


_ANSWER = pa.schema([("blk", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("top", pa.int64())])


def _apply(min_chars: int, id_at: str, text_at: str, columns: list[str]):
    def run(answers: pa.Table, docs: pa.Table) -> pa.Table:
        told = answers.to_pydict() if answers.num_rows else {"h1": [], "h2": [], "top": []}
        drop = dict(zip(zip(told["h1"], told["h2"], strict=True), told["top"], strict=True))
        kept, n_lines, n_dropped, sha = [], [], [], []
        for doc, text in zip(docs.column(id_at).to_pylist(), docs.column(text_at), strict=True):
            doc, raw = NO_DOC if doc is None else doc, text.as_py()
            lines = (raw or b"").split(b"\n")
            left = [x for x in lines if not drop or (k := line_key(x, min_chars)) is None or drop.get(_hash(k), doc) == doc]
            out = b"\n".join(left)
            kept.append(raw if raw is None else out.decode("utf-8", "replace"))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
            sha.append(hashlib.sha256(out).hexdigest())
        cols = [docs.column(c) for c in columns] + [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
        return pa.table(cols, names=[*columns, "kept_text", "n_lines", "n_dropped", "kept_sha256"])

    return run


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key is in ``min_docs`` or more documents, except in the largest id holding it.

    Returns the columns of ``docs`` and ``kept_text``, ``n_lines``,
    ``n_dropped``, ``kept_sha256`` (of ``kept_text``); input columns of these
    four names are replaced.

    A null or empty text is one empty line; a null text stays null in
    ``kept_text``. Every row counts as a document of its own, also repeated
    rows; rows tied for the largest id all keep the line. A null id is smaller
    than any other. A text that becomes free of lines is the empty string.
    An empty table gives an empty result. Ids are integers.
    """
    made = ["kept_text", "n_lines", "n_dropped", "kept_sha256"]
    docs = docs.drop(*made)
    block, raw, num = fresh(docs, "ld_block", "ld_raw", "ld_id")
    columns = docs.columns
    blocks = n_blocks(docs, text_col)
    dealt = in_blocks(docs, block, id_col, text_col, blocks).withColumns({raw: F.col(text_col).cast("binary"), num: F.col(id_col).cast("long")})
    keys = dealt.mapInArrow(  # all columns, so that both uses of ``dealt`` share one exchange
        _keys_of(min_chars, num, raw, block), "blk int, h1 long, h2 long, n long, top long")
    shards, groups = max(1, blocks * BLOCK_BYTES // SHARD_BYTES), -(-blocks // ASKING)
    shard, group = F.pmod("h1", F.lit(shards)).cast("int"), F.pmod("blk", F.lit(groups))
    index = keys.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    if groups > 1:
        wanted = keys.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), group.alias("part")).distinct()
        index = wanted.join(index, (F.col("w1") == F.col("h1")) & (F.col("w2") == F.col("h2")))
    else:
        index = index.withColumn("part", F.lit(0))
    index = index.select(shard.alias("shard"), "part", "h1", "h2", "n", "top")
    asked = keys.select("blk", "h1", "h2").distinct().select(shard.alias("ask_shard"), group.alias("ask_part"), F.col("blk").alias("blk"), F.col("h1").alias("a1"), F.col("h2").alias("a2"))  # names of their own: both sides come from ``keys``
    answers = index.groupBy("shard", "part").cogroup(asked.groupBy("ask_shard", "ask_part")).applyInArrow(_probe(min_docs), "blk int, h1 long, h2 long, top long")
    schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return answers.groupBy("blk").cogroup(dealt.groupBy(block)).applyInArrow(_apply(min_chars, num, raw, columns), schema)
