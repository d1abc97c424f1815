"""Ranked lexical search with sequential reads of impact-sorted lists (NRA, no random access).

Queries come in blocks of bounded size; for a block the documents are read
once and give, each, its length and the counts of the block's terms. Counts
over all documents give every term's weight. Documents then lie in shards; a
shard's postings are sorted by impact within each term, and every query reads
its terms' lists from the top, in blocks that double. What has been read gives
each document a lower bound of its score; what a list may still hold, the
impact of its last posting read, gives an upper one. Reading goes on until no
document outside can reach the best ten and every document that can has the
same bound on both sides: membership, ties and scores are then settled. The
shards' best meet by query.

Nothing is grouped by term, so a frequent word is a list in each shard, as
long as the shard at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize

#: What a term is made of: every character beyond ASCII, digits and letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes: A-Z lower-cased, ASCII that no term holds as a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of query terms in a block, which every task holds; a longer query is a block by itself.
QUERY_BYTES = 4 << 20
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 22
#: Postings of each list read first; each further read doubles what has been read.
FIRST_READ = 64


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds to a score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, first: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that are among the best ``k`` or tie with the last of them, their scores, and the postings read.

    ``lists``: for each term the impacts, falling, and the documents, 0 to ``n_docs`` - 1.
    """
    lower = np.zeros(n_docs, np.int64)
    docs_read: list[np.ndarray] = []
    list_read: list[np.ndarray] = []
    frontier = np.array([impact[0] if len(impact) else 0 for impact, _ in lists], np.int64)
    done = depth = 0
    while True:
        start, depth = depth, depth * 2 or first
        for i, (impact, doc) in enumerate(lists):
            if start < len(impact):
                np.add.at(lower, doc[start:depth], impact[start:depth])
                docs_read.append(doc[start:depth])
                list_read.append(np.full(len(docs_read[-1]), i))
                done += len(docs_read[-1])
                frontier[i] = impact[depth - 1] if depth < len(impact) else 0
        seen = np.zeros(n_docs, np.int64)  # what the lists that a document has been read in may still hold is not for it
        if docs_read:
            np.add.at(seen, np.concatenate(docs_read), frontier[np.concatenate(list_read)])
        upper = lower + (frontier.sum() - seen)
        least = max(1, int(np.partition(lower, n_docs - k)[n_docs - k]) if n_docs > k else 0)
        able = np.flatnonzero(upper >= least)
        if (upper[able] == lower[able]).all():
            return able, lower[able], done


class _Shard:
    """Postings of up to ``SHARD_DOCS`` documents, sorted by term and falling impact."""

    def __init__(self, docs: pa.Table, weight: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.ids = docs.column("doc").combine_chunks()
        tf = docs.column("tfs").combine_chunks()
        sizes = np.diff(tf.offsets.to_numpy())
        doc = np.repeat(np.arange(docs.num_rows), sizes)
        term, count = docs.column("terms").combine_chunks().flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
        m = 10 + (90 * docs.column("n").to_numpy() * n_docs) // n_terms
        impact = impacts(weight[term], count, m[doc])
        order = np.lexsort((-impact, term))
        self.term, self.doc, self.impact = term[order], doc[order], impact[order]

    def best(self, terms: np.ndarray, k: int) -> list[tuple[int | None, int]]:
        lo, hi = np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")
        lists = [(self.impact[a:b], self.doc[a:b]) for a, b in zip(lo, hi, strict=True) if b > a]
        if not lists:
            return []
        at, score, _ = nra(lists, len(self.ids), k)
        found = zip((self.ids[int(i)].as_py() for i in at), score.tolist(), strict=True)
        return sorted(found, key=lambda ds: (-ds[1], ds[0] is None, ds[0] or 0))[:k]


def _counts(index: dict[bytes, int]):
    """Rows (doc, n, terms, tfs) of the documents with a term: their length and the counts of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lengths, terms, tfs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if words:
                    own = Counter(map(index.get, words))
                    own.pop(None, None)
                    docs.append(doc)
                    lengths.append(len(words))
                    terms.append(list(own))
                    tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc", "n", "terms", "tfs"])

    return run


def _best_of_shards(weight: np.ndarray, queries: list[tuple[int | None, np.ndarray]], n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            shard = _Shard(pa.Table.from_batches(held), weight, n_docs, n_terms)
            rows = [(item, doc, score) for item, terms in queries for doc, score in shard.best(terms, k)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item", "doc", "score"])

        docs = postings = 0
        for batch in batches:
            held.append(batch)
            docs += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield out()
                held, docs, postings = [], 0, 0
        if docs:
            yield out()

    return run


def _block(docs: DataFrame, queries: list, k: int) -> DataFrame:
    """The best of every shard for one block's queries (id, terms)."""
    index = {t.encode(): i for i, t in enumerate(dict.fromkeys(t for q in queries for t in q["terms"]))}
    found = materialize(docs.mapInArrow(_counts(index), "doc long, n long, terms array<int>, tfs array<int>"))
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(index), np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most a row for each of the block's terms
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    asked = [(q["item"], np.array(sorted(index[t.encode()] for t in q["terms"]), np.int32)) for q in queries]
    return found.mapInArrow(_best_of_shards(weight, asked, n_docs, n_terms or 1, k), "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_id, rank, doc_id, score.

    Equal scores go by ascending doc_id, a null id last; only scores above 0
    are listed. A null text has no term. Every row of ``docs`` is a document of
    its own, repeated rows too. Rows that share an item_id, null included, are
    one query with the terms of all. An item without terms, or whose terms no
    document holds, gives no rows; nor do empty tables. Other columns are not
    used, so their names can't clash. Ids are integers.
    """
    spark = docs.sparkSession
    terms = F.regexp_extract_all(F.translate(F.coalesce(item_text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = items.select(F.col(item_id).cast("long").alias("item"), terms.alias("terms")).groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter("size(terms) > 0")
    asked = materialize(asked)
    size = asked.agg(F.sum(F.octet_length(F.array_join("terms", " ")))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).cast("binary").alias("text"))
    best = spark.createDataFrame([], "item long, doc long, score long")
    for i in range(blocks):
        queries = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()  # a block of about QUERY_BYTES
        if queries:
            best = best.unionAll(_block(rows, queries, k))
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
