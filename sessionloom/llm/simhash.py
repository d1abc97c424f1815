"""SimHash near-dedup by a binary-trie self-join.

Fingerprints are made per document in Arrow batches. Only distinct
fingerprints take part in the join; equal ones share a class. The binary trie
of the fingerprints is joined with itself: pairs of nodes are walked down
together from the root, each pair carries the number of bits in which its
nodes' prefixes differ, and a pair beyond ``max_bits`` is pruned. The first
levels of the walk are Spark's: the pairs of nodes at the depth where a node
holds about ``NODE`` fingerprints are the groups, and a fingerprint goes to
every pair within the budget that its own node is in. A pair of nodes with
more than ``SPLIT`` fingerprints is walked down further in the same way. Below,
a task walks on through sorted arrays down to leaves. Each task returns a
spanning forest of the links it found, never all pairs; components are then
settled by star contractions on Spark.

``similar_groups`` asks for a similarity of shingle sets instead of a number of
bits. At a similarity of 0.8 fingerprints of 64 bits differ in about ten, too
many for a trie's budget, so each document has several shorter fingerprints,
each with a trie of its own; what any of them links is a candidate, held
against long fingerprints and then against the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Forest, connected_components, fresh, materialize

BITS = 64
#: Fingerprints of a node at the depth where tasks take over, which is ``LEAST_DEPTH`` at least.
NODE, LEAST_DEPTH = 1 << 18, 4
#: Pairs of nodes with more fingerprints are walked down on Spark by so many further levels.
SPLIT, DEEPER = 1 << 20, 6
#: Fingerprints of a leaf.
LEAF = 2
#: Pairs of nodes that a step of the walk takes together.
STEP = 1 << 18
_ONE = np.uint64(1)


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of ASCII-lower-cased word shingles; zero without words."""
    words = (text or b"").lower().split()  # bytes.split and bytes.lower know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 16):  # a very long text in slices
        hi = min(n, lo + (1 << 16))
        if n == 1:
            h = np.array([digest(b" ".join(words), seed)], "<u8")
        else:
            part = words[lo : hi + width - 1]
            h = np.fromiter(map(digest, map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)), [seed] * (hi - lo)), "<u8", hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(text_at: str, out: str, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column(text_at)), "<u8", batch.num_rows)
            names = [c for c in batch.schema.names if c != text_at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(prints.view("<i8"))], names=[*names, out])

    return run


def with_fingerprint(docs: DataFrame, out: str, text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with the fingerprint's bits as a signed long in column ``out``."""
    (raw,) = fresh(docs, "sh_raw")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])
    return docs.withColumn(raw, F.col(text_col).cast("binary")).mapInArrow(_fingerprints(raw, out, width, seed), schema)


def trie_links(prints: np.ndarray, max_bits: int, first: int | None = None, depth: int = 0, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among sorted distinct uint64 fingerprints, as two index arrays; each pair is a link.

    Walks down the pair of the whole array with itself, or of its first
    ``first`` fingerprints with the others, all of which share their leading
    ``depth`` bits on either side. A node is a range of the array that shares
    its leading bits; a pair (a node with itself, or two nodes) becomes up to
    four pairs of children, of which a 0-child with a 1-child costs one
    differing bit. Pairs over budget are pruned; pairs of leaves are compared.
    ``seen`` gathers the numbers of pairs walked, pruned and compared.
    """
    n = len(prints)
    forest = Forest(n)
    seen = {} if seen is None else seen
    ones: dict[int, np.ndarray] = {}
    split = n if first is None else first
    whole = (0, split, 0 if first is None else split, n)
    spent = 0 if first is None or not 0 < split < n else (int(prints[0]) >> (BITS - depth) ^ int(prints[-1]) >> (BITS - depth)).bit_count()
    todo = [(BITS - 1 - depth, np.array([[*whole, spent]], np.int64))] if whole[0] < whole[1] and whole[2] < whole[3] and n > 1 else []
    while todo:
        bit, pairs = todo.pop()
        if len(pairs) > STEP:
            todo.append((bit, pairs[STEP:]))
            pairs = pairs[:STEP]
        lo1, hi1, lo2, hi2, _ = pairs.T
        leaves = ((hi1 - lo1 <= LEAF) & (hi2 - lo2 <= LEAF)) | (bit < 0)
        _compare(prints, pairs[leaves], max_bits, forest)
        seen["compared"] = seen.get("compared", 0) + int(leaves.sum())
        lo1, hi1, lo2, hi2, spent = pairs[~leaves].T
        if not len(lo1):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((prints >> np.uint64(bit)) & _ONE, dtype=np.int32)])
        below = ones[bit]
        # within a node, fingerprints with the bit unset come first
        mid1, mid2 = hi1 - (below[hi1] - below[lo1]), hi2 - (below[hi2] - below[lo2])
        two = lo1 != lo2  # of a node with itself, the mirror image is left out
        kids = [(lo1, mid1, lo2, mid2, spent), (mid1, hi1, mid2, hi2, spent), (lo1, mid1, mid2, hi2, spent + 1), tuple(x[two] for x in (mid1, hi1, lo2, mid2, spent + 1))]
        kids = np.concatenate([np.stack(x, axis=1) for x in kids])
        kids = kids[(kids[:, 1] > kids[:, 0]) & (kids[:, 3] > kids[:, 2])]
        kids = kids[(kids[:, 0] != kids[:, 2]) | (kids[:, 1] - kids[:, 0] > 1)]  # no pair of a fingerprint with itself
        on = kids[:, 4] <= max_bits
        seen["walked"] = seen.get("walked", 0) + len(lo1)
        seen["pruned"] = seen.get("pruned", 0) + int((~on).sum())
        if on.any():
            todo.append((bit - 1, kids[on]))
    return forest.links()


def _compare(prints: np.ndarray, pairs: np.ndarray, max_bits: int, forest: Forest) -> None:
    lo1, hi1, lo2, hi2, _ = pairs.T
    for i in range(int((hi1 - lo1).max(initial=0))):
        for j in range(int((hi2 - lo2).max(initial=0))):
            a, b = lo1 + i, lo2 + j
            on = (a < hi1) & (b < hi2) & (a != b)
            a, b = a[on], b[on]
            near = np.bitwise_count(prints[a] ^ prints[b]) <= max_bits
            forest.link(a[near], b[near])


def _within(bits: int, budget: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``budget`` set."""
    return [sum(1 << b for b in chosen) for k in range(budget + 1) for chosen in combinations(range(bits), k)]


def _deal(rows: DataFrame, depth: int, more: int, max_bits: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (fp, ``extra``, a, b: prefixes of ``depth`` bits that make a pair, one of them fp's own) at pairs of children ``more`` levels below."""
    prefix = lambda bits: F.shiftrightunsigned("fp", BITS - bits) if bits else F.lit(0).cast("long")
    spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    masks = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for k in range(max_bits + 1):
        masks = masks.when(spent == k, F.array(*(F.lit(m).cast("long") for m in _within(more, max_bits - k))))
    own = prefix(depth + more)
    deeper = rows.select("fp", *extra, (F.col("a") == F.col("b")).alias("same"), (prefix(depth) == F.col("a")).alias("left"), own.alias("own"), F.col("a").bitwiseXOR(F.col("b")).alias("apart"), F.explode(masks).alias("mask"))
    other = F.col("own").bitwiseXOR(F.col("mask")).bitwiseXOR(F.shiftleft("apart", more))
    left = F.when(F.col("same"), F.least("own", other)).when(F.col("left"), F.col("own")).otherwise(other)
    right = F.when(F.col("same"), F.greatest("own", other)).when(F.col("left"), other).otherwise(F.col("own"))
    return deeper.select("fp", *extra, left.alias("a"), right.alias("b"))


def _walk(max_bits: int, depth: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        prints = np.unique(rows.column("fp").to_numpy().view(np.uint64))
        first = None
        if a != b:
            first = int(np.searchsorted(prints, np.uint64(b << (BITS - depth))))
        i, j = trie_links(prints, max_bits, first, depth)
        return pa.table({"a": prints[i].view(np.int64), "b": prints[j].view(np.int64)})

    return run


def fingerprint_links(prints: DataFrame, max_bits: int = 2, col: str = "fp") -> DataFrame:
    """Links (a, b) among distinct signed-long fingerprints whose components are those of all pairs within ``max_bits``."""
    distinct = materialize(prints.select(F.col(col).alias("fp")).distinct())
    n = distinct.count()
    depth = max(LEAST_DEPTH, (-(-n // NODE) - 1).bit_length())
    zero = F.lit(0).cast("long")
    rows = _deal(distinct.select("fp", zero.alias("a"), zero.alias("b")), 0, depth, max_bits)
    found = []
    while True:
        sizes = rows.groupBy("a", "b").count().filter(F.col("count") > SPLIT).select(F.col("a").alias("l_a"), F.col("b").alias("l_b"))
        large = materialize(sizes)
        on = (F.col("a") == F.col("l_a")) & (F.col("b") == F.col("l_b"))
        last = depth + DEEPER >= BITS or large.isEmpty()
        own = rows if last else rows.join(large, on, "left_anti")
        found.append(own.groupBy("a", "b").applyInArrow(_walk(max_bits, depth), "a long, b long"))
        if last:
            break
        rows = materialize(_deal(rows.join(large, on, "left_semi"), depth, DEEPER, max_bits))
        depth += DEEPER
    return reduce(DataFrame.unionAll, found).distinct()


def simhash_groups(docs: DataFrame, max_bits: int = 2, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all if None), ``fingerprint`` (16 hex digits) and ``component_id`` (least id of the component).

    Input columns of these two names are replaced. A null, empty or blank text
    has fingerprint zero, which links like any other; a text of fewer words
    than ``width`` is one shingle. Repeated rows are equal and share a
    component. A null id is a ``component_id`` only where all ids of the
    component are null. An empty table gives an empty result.
    """
    docs = docs.drop("fingerprint", "component_id")
    columns = [c for c in columns or docs.columns if c in docs.columns]
    fp, ident, raw = fresh(docs, "sh_fp", "sh_id", "sh_text")
    printed = materialize(with_fingerprint(docs.select(*columns, F.col(id_col).alias(ident), F.col(text_col).cast("binary").alias(raw)), fp, raw, width, seed).drop(raw))
    least = materialize(printed.groupBy(F.col(fp).alias("fp")).agg(F.min(ident).alias("least")))
    parts = connected_components(fingerprint_links(least, max_bits), "a", "b")
    of = least.join(parts, least.fp == parts.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of.join(named, "root").select(F.col("fp").alias("class_fp"), F.col("component_id"))
    return printed.join(classes, F.col(fp) == F.col("class_fp")).select(*columns, F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"), "component_id")


# -- groups by similarity of shingle sets ---------------------------------------

#: Share of pairs at the least similarity that some table must link, and false candidates of a document in a table, at most.
RECALL, FALSE = 0.95, 1 / 32
#: Fingerprints of a table's node; these are short.
TABLE_NODE = 1 << 20
#: Standard deviations of the long fingerprint's distance that are let through.
SPREAD = 4.0
#: Rows of group members up to which they are broadcast.
MEMBER_ROWS = 100_000


def table_plan(n: int, similarity: float, max_bits: int = 2) -> tuple[int, int, float]:
    """(bits of a table, tables, share of bits in which sets of that similarity differ) for ``n`` documents.

    Bits are as many as keep false candidates below ``FALSE``; tables as many
    as reach ``RECALL``. Both grow with the logarithm of ``n``.
    """
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    bits = 32
    while n * sum(math.comb(bits, k) for k in range(max_bits + 1)) > FALSE * 2**bits:
        bits += 4
    hit = sum(math.comb(bits, k) * share**k * (1 - share) ** (bits - k) for k in range(max_bits + 1))
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))) if hit < 1 else 1, share


def shingle_set(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """Distinct 64-bit hashes of ASCII-lower-cased word shingles, sorted; a text of fewer words is one shingle, without words there is none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    n = len(words) - width + 1
    grams = map(b" ".join, zip(*(words[i : n + i] for i in range(width)), strict=True))
    return np.unique(np.fromiter((digest(g, seed) for g in grams), np.uint64, n))


def long_print(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` 64-bit words: each shingle's hash is mixed anew for every word."""
    ones = np.zeros((words, BITS), np.int64)
    for lo in range(0, len(shingles), 4096):
        h = shingles[lo : lo + 4096]
        for i in range(words):
            x = h + np.uint64((i * 0x9E3779B97F4A7C15) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones[i] += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), axis=1, bitorder="little").view("<u8").ravel()


def _cut(words: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A table's fingerprint each, its bits at the top."""
    flat = np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[: bits * tables].reshape(tables, bits)
    return np.packbits(np.pad(flat, ((0, 0), (0, BITS - bits))), axis=1).view(">u8").ravel().astype(np.uint64)


def _keys(raw: str, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxhash.xxh3_64_intdigest(shingle_set(x.as_py(), width, seed).tobytes()) - (1 << 63) for x in batch.column(raw)]
            names = [c for c in batch.schema.names if c != raw]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(keys, pa.int64())], [*names, "sg_key"])

    return run


def _sketches(width: int, seed: int, bits: int, tables: int):
    words = -(-bits * tables // BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, longs, sets = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width, seed)
                long = long_print(s, words)
                keys.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                prints.append(_cut(long, bits, tables).view(np.int64))
                longs.append(long.astype(np.uint64).view(np.int64))
                sets.append((s & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(longs, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))], ["id", "key", "prints", "long", "shingles"])

    return run


def _candidates(max_bits: int, depth: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a, b = key[1].as_py(), key[2].as_py()
        fp, keys = rows.column("fp").to_numpy().view(np.uint64), rows.column("key").to_numpy()
        by = np.lexsort((keys, fp))
        fp, keys = fp[by], keys[by]
        head = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        prints, least = fp[head], keys[head]
        first = None if a == b else int(np.searchsorted(prints, np.uint64(b << (BITS - depth))))
        i, j = trie_links(prints, max_bits, first, depth)
        same = np.repeat(least, np.diff(np.append(head, len(fp))))  # equal fingerprints: each with the first
        k1, k2 = np.concatenate([least[i], keys]), np.concatenate([least[j], same])
        on = k1 != k2
        return pa.table({"k1": np.minimum(k1, k2)[on], "k2": np.maximum(k1, k2)[on]})

    return run


def _beside(pairs: DataFrame, sketches: DataFrame, c: str) -> DataFrame:
    """``pairs`` (k1, k2) with column ``c`` of either document's sketch as ``v1`` and ``v2``.

    Only sketches that pairs name are shuffled; while those are few, their keys
    go to where the sketches are, so the others stay where they lie.
    """
    named = materialize(pairs.select(F.col("k1").alias("key")).unionAll(pairs.select(F.col("k2").alias("key"))).distinct())
    if named.count() <= MEMBER_ROWS:
        named = F.broadcast(named)
    have = sketches.select("key", c).join(named, "key", "left_semi").dropDuplicates(["key"])
    for i in (1, 2):
        pairs = pairs.join(have.select(F.col("key").alias(f"key{i}"), F.col(c).alias(f"v{i}")), F.col(f"k{i}") == F.col(f"key{i}")).drop(f"key{i}")
    return pairs


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Groups of documents linked by a Jaccard similarity of their shingle sets of at least ``similarity``.

    Returns ``docs`` with ``component_id`` (least id of the group, null only if
    all are null), and the verified links between different sets (k1, k2,
    similarity). Links are exact, sets being compared by 32-bit hashes; a pair
    at the least similarity is found with probability ``RECALL``, more similar
    ones nearly always. Null, empty and blank texts have the same empty set and
    are one group; equal rows are one group. An input column of that name is
    replaced. An empty table gives an empty result.
    """
    docs = docs.drop("component_id")
    (raw,) = fresh(docs, "sg_raw")
    n = docs.count()
    bits, tables, share = table_plan(n, similarity, max_bits)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias(raw))
    kind = docs.schema[id_col].dataType.simpleString()
    sketches = materialize(plain.mapInArrow(_sketches(width, seed, bits, tables), f"id {kind}, key long, prints array<long>, long array<long>, shingles array<int>"))
    classes = materialize(sketches.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    depth = max(0, (-(-n // TABLE_NODE) - 1).bit_length())
    rows = sketches.select("key", F.posexplode("prints").alias("t", "fp")).distinct()
    if depth:
        zero = F.lit(0).cast("long")
        dealt = _deal(rows.withColumns({"a": zero, "b": zero}), 0, depth, max_bits, ("key", "t"))
    else:
        dealt = rows.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})
    pairs = materialize(dealt.groupBy("t", "a", "b").applyInArrow(_candidates(max_bits, depth), "k1 long, k2 long").distinct())
    # the long fingerprints leave few false candidates, and only those meet as sets
    whole = -(-bits * tables // BITS) * BITS
    most = whole * share + SPREAD * math.sqrt(whole * share * (1 - share))
    apart = F.aggregate(F.zip_with("v1", "v2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = materialize(_beside(pairs, sketches, "long").filter(apart <= most).select("k1", "k2"))
    both = F.size(F.array_intersect("v1", "v2"))
    links = materialize(_beside(close, sketches, "shingles").select("k1", "k2", (both / (F.size("v1") + F.size("v2") - both)).alias("similarity")).filter(F.col("similarity") >= similarity))
    parts = connected_components(links, "k1", "k2")
    of = classes.join(parts, classes.key == parts.node, "left").select("key", F.coalesce("component", "key").alias("root"), "least", "n")
    named = of.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows"))
    members = materialize(of.join(named.filter("rows > 1"), "root").select(F.col("key").alias("sg_member"), "component_id"))
    if members.count() <= MEMBER_ROWS:
        members = F.broadcast(members)
    keyed = docs.withColumn(raw, F.col(text_col).cast("binary")).mapInArrow(_keys(raw, width, seed), T.StructType([*docs.schema.fields, T.StructField("sg_key", T.LongType())]))
    joined = keyed.join(members, F.col("sg_key") == F.col("sg_member"), "left")
    alone = F.col("sg_member").isNull()
    return joined.select(*docs.columns, F.when(alone, F.col(id_col)).otherwise(F.col("component_id")).alias("component_id")), links
