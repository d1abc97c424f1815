"""Helpers that the text and embedding operators share.

* ``shared_dir`` / ``materialize``: cut lineage with a written table in the
  folder that ``spark.checkpoint.dir`` names, which every executor can read.
* ``in_blocks``: deal documents by a hash of their content into blocks of a
  few MB. A block is the unit to which answers are sent back (lines to drop,
  word counts, covered spans), so that no answer table is ever broadcast.
* ``connected_components``: alternating large-star / small-star on DataFrames.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block; a block and its answers are one task's group.
BLOCK_BYTES = 4 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with ``names`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temporary one only on a local master where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute it nor need its shuffle files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def n_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-text_bytes(docs, text) // block_bytes))


def in_blocks(docs: DataFrame, block: str, id_col: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """``docs`` with a column ``block``, hash partitioned by it.

    The block is a hash of id and text, so a hot source or null ids spread
    evenly. Plans that use the result twice share one exchange.
    """
    spark = docs.sparkSession
    n = blocks or n_blocks(docs, text)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 2))
    return docs.withColumn(block, F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(n)).cast("int")).repartition(parts, F.col(block))


class Forest:
    """Union-find over 0..n-1 that takes arrays of links; ``edges`` are links that made two trees one, a spanning forest of all."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook roots to smaller ones until every link lies within a tree."""
        while len(a):
            ra, rb = self.find(a), self.find(b)
            on = ra != rb
            a, b, high, low = a[on], b[on], np.maximum(ra, rb)[on], np.minimum(ra, rb)[on]
            by = np.lexsort((low, high))
            first = by[np.flatnonzero(np.concatenate([[True], np.diff(high[by]) != 0]))] if len(by) else by
            self.root[high[first]] = low[first]
            self.edges.append((a[first], b[first]))

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if (up == r).all():
                return r
            self.root[x] = r = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The spanning forest as two arrays."""
        return tuple(np.concatenate([np.empty(0, np.int64), *(e[i] for e in self.edges)]) for i in (0, 1))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star (neighbours above the node) or small-star (at or below it) step on edges (a > b)."""
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(own)
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph of long ids: rows (node, component), component the least id.

    Nodes without an edge don't appear. Each round halves the distances, so
    the number of rounds is logarithmic; a node of high degree is only ever a
    join key whose partner is one row. Self loops, repeated edges and nulls
    are ignored. An empty edge table gives an empty result.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(F.col(a), F.col(b)).cast("long").alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct()
    )
    state = None
    for _ in range(max_rounds):
        cur = materialize(_stars(_stars(cur, True), False))
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
