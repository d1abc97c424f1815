"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of ``length`` bytes counts as repeated if it starts at two or more
places of the corpus. Sorting all suffixes would move the corpus many times
over, so suffixes are sorted at anchors only: of the ``length - GRAM + 1``
substrings of ``GRAM`` bytes within a string, the one of least hash (leftmost)
anchors it. Equal strings have the same anchor at the same place. Anchors
whose hash occurs once are dropped; blocks of documents get back the hashes of
their own that repeat and send, for each such anchor, the bytes around it.

Equal contexts of a block are one row. Per shard of the hash space, contexts
of equal anchors are mergesorted by what follows the anchor and by what
precedes it. A comparison finds the common extension by binary search over
prefix polynomial hashes; all comparisons of a merge step run together, and the
extensions of neighbours are verified on the bytes. Two contexts share the
string that begins ``i`` bytes before the anchor if both orders put them into
one run of extensions that long, which settles every string exactly. Anchors of
more than ``HOT`` rows don't meet in one shard: their strings are dealt by
128-bit hashes of their own, equal strings of a block are still one row, and
a string repeats if its rows of all blocks hold two or more copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, in_blocks, text_bytes

LENGTH = 200
#: Bytes of an anchor.
GRAM = 100
#: Starts of strings that one pass over a text takes.
PASS = 1 << 20
#: Bytes of text for each shard of anchors.
SHARD_BYTES = 4 << 20
#: Rows (one a block and batch) from which an anchor is hot: its strings then go to shards of their own, one by one.
HOT = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PASS + LENGTH, _BASE)]))
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PASS + LENGTH, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes along the last axis (one more than the codes)."""
    terms = _BYTES[codes] * _POWERS[: codes.shape[-1]]
    out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), np.uint64)
    np.cumsum(terms, axis=-1, out=out[..., 1:])
    return out


def _grams(codes: np.ndarray, gram: int) -> np.ndarray:
    """Mixed hash of the ``gram`` bytes from each position."""
    h = prefix_hashes(codes)
    g = (h[gram:] - h[:-gram]) * _INVERSE[: len(codes) - gram + 1]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    return g


def anchors(codes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of each anchor of the strings of ``codes``; starts of one anchor are consecutive."""
    if len(codes) < length:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    g = _grams(codes, gram)
    width = length - gram + 1
    low, at = g, np.arange(len(g), dtype=np.int32)
    span = 1
    while span < width:  # leftmost least of windows of doubling width
        step = min(span, width - span)
        left, right = low[: len(low) - step], low[step:]
        take = right < left
        low, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        span += step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    p = at[first].astype(np.int64)
    return g[p], p, first, last


def _passes(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Codes of many short texts or part of a long one, and (row, offset in the codes, offset in the text, bytes) of each."""
    parts, rows, size = [], [], 0
    for row, text in enumerate(texts):
        if len(text) < length:
            continue
        for lo in range(0, len(text) - length + 1, PASS):
            piece = text[lo : lo + PASS + length - 1]
            if size + len(piece) > PASS + length - 1:
                yield np.frombuffer(b"".join(parts), np.uint8), rows
                parts, rows, size = [], [], 0
            rows.append((row, size, lo, len(piece)))
            parts.append(piece)
            size += len(piece)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), rows


def text_anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, place, first start, last start) of anchors, places and starts within the row's text."""
    for codes, rows in _passes(texts, length):
        row, off, base, size = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        h, p, first, last = anchors(codes, length, gram)
        # a text's own strings: cut the runs of starts at the ends of the texts
        k = np.searchsorted(off, first, "right") - 1
        k_last = np.searchsorted(off, last, "right") - 1
        extra = np.flatnonzero(k_last > k)
        where = np.concatenate([np.arange(len(p)), np.repeat(extra, (k_last - k)[extra])])
        nth = np.concatenate([np.zeros(len(p), np.int64), _counting((k_last - k)[extra]) + 1])
        t = k[where] + nth
        lo, hi = np.maximum(first[where], off[t]), np.minimum(last[where], off[t] + size[t] - length)
        ok = (hi >= lo) & (p[where] >= off[t])
        where, t, lo, hi = where[ok], t[ok], lo[ok], hi[ok]
        shift = base[t] - off[t]
        yield row[t], h[where].view(np.int64), p[where] + shift, lo + shift, hi + shift


def _counting(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


# -- the sort ----------------------------------------------------------------


class _Suffixes:
    """Byte strings of bounded length in rows, compared by prefix hashes."""

    def __init__(self, strings: list[bytes], width: int) -> None:
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.codes = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width) if width else np.zeros((len(strings), 0), np.uint8)
        self.hash = prefix_hashes(self.codes)
        self.width = width

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for _ in range(int(self.width).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.hash[a, mid] == self.hash[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``common``, held against the bytes: at a collision the bytes decide."""
        n = self.common(a, b)
        for lo in range(0, len(a), 4096):
            s = slice(lo, lo + 4096)
            differ = (self.codes[a[s]] != self.codes[b[s]]) & (np.arange(self.width) < n[s, None])
            wrong = differ.any(axis=1)
            n[s] = np.where(wrong, differ.argmax(axis=1) if self.width else 0, n[s])
        return n

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        ends_a, ends_b = n >= self.size[a], n >= self.size[b]
        at = np.minimum(n, max(self.width - 1, 0))
        lower = self.codes[a, at] < self.codes[b, at] if self.width else np.zeros(len(a), bool)
        return np.where(ends_a & ends_b, or_equal, np.where(ends_a, True, np.where(ends_b, False, lower)))

    def mergesort(self, group: np.ndarray) -> np.ndarray:
        """Order of the rows within runs of equal ``group`` (rows come grouped); every merge level is one set of array steps."""
        n = len(group)
        order = np.arange(n)
        new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        start = np.flatnonzero(new)[np.cumsum(new) - 1] if n else order
        size = np.bincount(start, minlength=n)[start] if n else order
        width = 1
        while n and width < size.max():
            slot = np.flatnonzero(size > width)  # places whose groups have more runs to merge
            rel = slot - start[slot]
            run = rel // width
            left = run % 2 == 0
            other = start[slot] + (run + np.where(left, 1, -1)) * width
            stop = np.minimum(other + width, start[slot] + size[slot])
            lo, hi = other.copy(), np.maximum(stop, other)
            me = order[slot]
            while (open_ := lo < hi).any():  # how many of the other run come before
                i = np.flatnonzero(open_)
                mid = (lo[i] + hi[i]) >> 1
                before = self.less(order[mid], me[i], ~left[i])
                # equal rows: those of the left run stay first
                lo[i], hi[i] = np.where(before, mid + 1, lo[i]), np.where(before, hi[i], mid)
            base = start[slot] + (run - run % 2) * width
            place = base + rel % width + (lo - other)
            order[place] = me
            width *= 2
        return order


def repeated_offsets(group: np.ndarray, before: list[bytes], after: list[bytes], nearest: np.ndarray, copies: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For contexts grouped by anchor: a matrix [context, i] saying that the string from i bytes before the anchor is repeated.

    ``before`` are the bytes up to the anchor, ``after`` those behind it,
    ``nearest`` the least i of a context and ``copies`` how often it occurs.
    """
    n, most = len(group), length - gram
    out = np.zeros((n, most + 1), bool)
    if not n:
        return out
    sides = [_Suffixes([s[::-1] for s in before], most), _Suffixes(after, most)]
    farthest = sides[0].size
    orders, breaks = [], []
    for side in sides:
        order = side.mergesort(group)
        near = np.zeros(n, np.int64)
        near[1:] = side.verified(order[1:], order[:-1])
        near[np.concatenate([[True], group[order][1:] != group[order][:-1]])] = -1
        orders.append(order)
        breaks.append(near)
    run = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for i in range(most + 1):
        ok = np.flatnonzero((nearest <= i) & (i <= farthest))
        if len(ok) == 0:
            continue
        for k, need in ((0, i), (1, most - i)):
            run[k][orders[k]] = np.cumsum(breaks[k] < need)
        key = run[0][ok] * (n + 1) + run[1][ok]
        by = np.argsort(key)
        edge = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        total = np.add.reduceat(copies[ok][by], edge)
        out[ok[by], i] = np.repeat(total >= 2, np.diff(np.append(edge, len(by))))
    return out


# -- jobs --------------------------------------------------------------------


def _hashes(raw: str, block: str, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(block).to_numpy()
            for lo, hi in _slices(batch.column(raw)):
                texts = [x.as_py() or b"" for x in batch.column(raw)[lo:hi]]
                for row, h, *_ in text_anchors(texts, length, gram):
                    blk = blocks[lo:hi][row]
                    by = np.lexsort((h, blk))
                    h, blk = h[by], blk[by]
                    edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (blk[1:] != blk[:-1])])) if len(h) else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(blk[edge].astype(np.int32)), pa.array(h[edge]), pa.array(np.diff(np.append(edge, len(h))).astype(np.int64))], ["blk", "h", "n"])

    return run


def _slices(column: pa.Array, rows: int = 2000) -> Iterator[tuple[int, int]]:
    for lo in range(0, len(column), rows):
        yield lo, min(lo + rows, len(column))


def _row_id(doc: object, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, xxhash.xxh3_64_intdigest(repr(doc).encode())) - (1 << 63)


_CONTEXT = pa.schema([("shard", pa.int32()), ("h", pa.int64()), ("h2", pa.int64()), ("nearest", pa.int32()), ("before", pa.binary()), ("after", pa.binary()), ("whole", pa.bool_()), ("blk", pa.int32()), ("places", pa.binary())])


def _contexts(ident: str, raw: str, length: int, gram: int, shards: int):
    def run(wanted: pa.Table, docs: pa.Table) -> pa.Table:
        if not wanted.num_rows or not docs.num_rows:
            return _CONTEXT.empty_table()
        repeat = np.unique(wanted.column("h").to_numpy())
        hot = set(wanted.column("h").to_numpy()[wanted.column("hot").to_numpy(zero_copy_only=False)].tolist())
        blk = wanted.column("blk")[0].as_py()
        texts = [x.as_py() or b"" for x in docs.column(raw)]
        names = [_row_id(d, t) for d, t in zip(docs.column(ident).to_pylist(), texts, strict=True)]
        found: dict[tuple, list[int]] = {}
        digest = xxhash.xxh3_64_intdigest
        for row, h, p, first, last in text_anchors(texts, length, gram):
            at = np.searchsorted(repeat, h)
            ok = np.flatnonzero((at < len(repeat)) & (repeat[np.minimum(at, len(repeat) - 1)] == h))
            for r, a, q, lo, hi in zip(*(x[ok].tolist() for x in (row, h, p, first, last)), strict=True):
                text = texts[r]
                if a in hot:  # each string is a row of its own, told apart by its hashes alone
                    strings = ((x, text[x : x + length]) for x in range(lo, hi + 1))
                    keyed = [((digest(w) - (1 << 63), digest(w, 1) - (1 << 63), 0, b"", b"", True), x) for x, w in strings]
                else:
                    keyed = [((a, digest(text[q : q + gram]) - (1 << 63), q - hi, text[lo:q], text[q + gram : hi + length], False), q)]
                for key, place in keyed:
                    got = found.get(key)
                    if got is None:
                        found[key] = [names[r], place]
                    else:
                        got += (names[r], place)
        cols = list(zip(*found, strict=True)) or [()] * 6
        shard = (np.array(cols[0], np.int64).view(np.uint64) % np.uint64(shards)).astype(np.int32)
        return pa.table([pa.array(shard), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()), strict=True)), pa.array([blk] * len(found), pa.int32()), pa.array([np.array(v, np.int64).tobytes() for v in found.values()], pa.binary())], schema=_CONTEXT)

    return run


_SPAN = pa.schema([("blk", pa.int32()), ("row_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _settle(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        whole, h, h2 = (table.column(c).to_numpy() for c in ("whole", "h", "h2"))
        by = np.lexsort((h2, h, whole))  # whole strings last
        table = table.take(pa.array(by))
        whole, h, h2 = whole[by], h[by], h2[by]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (whole[1:] != whole[:-1])])
        group = np.cumsum(new)
        places = [np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) for x in table.column("places")]
        copies = np.fromiter(map(len, places), np.int64, len(places))
        n = int(np.count_nonzero(~whole))
        parts = table.slice(0, n)
        hit = np.zeros((len(group), length - gram + 1), bool)
        hit[:n] = repeated_offsets(group[:n], parts.column("before").to_pylist(), parts.column("after").to_pylist(), parts.column("nearest").to_numpy(), copies[:n], length, gram)
        hit[n:, 0] = (np.add.reduceat(copies, np.flatnonzero(new)) >= 2)[group[n:] - 1]  # a whole string repeats by its copies over all blocks
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        ctx, lo = np.nonzero(edge == 1)
        hi = np.nonzero(edge == -1)[1] - 1  # in the same order, run by run
        blk = table.column("blk").to_numpy()
        n = copies[ctx]
        flat = np.concatenate([places[c] for c in ctx]) if len(ctx) else np.empty((0, 2), np.int64)
        return pa.table([pa.array(np.repeat(blk[ctx], n).astype(np.int32)), pa.array(flat[:, 0].copy()), pa.array(flat[:, 1] - np.repeat(hi, n)), pa.array(flat[:, 1] - np.repeat(lo, n) + length)], schema=_SPAN)

    return run


def _cut(ident: str, raw: str, columns: list[str]):
    def run(spans: pa.Table, docs: pa.Table) -> pa.Table:
        at: dict[int, tuple[int, int]] = {}
        start = stop = np.empty(0, np.int64)
        if spans.num_rows:
            rows, start, stop = (spans.column(c).to_numpy() for c in ("row_id", "start", "stop"))
            by = np.lexsort((start, rows))
            rows, start, stop = rows[by], start[by], stop[by]
            hit, first, n = np.unique(rows, return_index=True, return_counts=True)
            at = {r: (a, a + k) for r, a, k in zip(hit.tolist(), first.tolist(), n.tolist(), strict=True)}
        kept, n_bytes, n_removed, n_spans, sha = [], [], [], [], []
        for doc, text in zip(docs.column(ident).to_pylist(), docs.column(raw), strict=True):
            raw_text = text.as_py()
            text = raw_text or b""
            gone = runs = 0
            left = text
            if (own := at.get(_row_id(doc, text))) is not None:
                s, e = start[own[0] : own[1]], np.maximum.accumulate(stop[own[0] : own[1]])
                head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                lo, hi = s[head], e[np.append(head[1:], len(s)) - 1]
                left = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
                gone, runs = int((hi - lo).sum()), len(lo)
            kept.append(None if raw_text is None else left)
            n_bytes.append(len(text))
            n_removed.append(gone)
            n_spans.append(runs)
            sha.append(hashlib.sha256(left).hexdigest())
        cols = [docs.column(c) for c in columns] + [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string())]
        return pa.table(cols, names=[*columns, "kept_bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` and ``kept_bytes``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``.

    Every byte within a string of ``length`` bytes that also starts anywhere
    else, judged on the input, is removed. Strings never cross documents.
    Input columns of these five names are replaced. ``kept_bytes`` may cut
    characters, as strings are of bytes.

    A null text is empty, and null in ``kept_bytes``. Texts shorter than
    ``length`` stay whole. Repeated rows are documents of their own: each
    loses what it shares with the others. Null ids are kept apart by their
    texts. An empty table gives an empty result.
    """
    gram = gram or length // 2
    if not 1 <= gram < length <= PASS:
        raise ValueError("gram must be shorter than length")
    made = ["kept_bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*made)
    block, raw = fresh(docs, "sd_block", "sd_raw")
    columns = docs.columns
    dealt = in_blocks(docs, block, id_col, text_col).withColumn(raw, F.col(text_col).cast("binary"))
    shards = max(1, -(-text_bytes(docs, text_col) // SHARD_BYTES))
    # a block repeats a hash within itself or shares it with another block
    hashes = dealt.mapInArrow(_hashes(raw, block, length, gram), "blk int, h long, n long")
    counts = hashes.groupBy("h").agg(F.sum("n").alias("n_all"), F.count("*").alias("n_rows")).filter("n_all > 1").select(F.col("h").alias("h_all"), (F.col("n_rows") > HOT).alias("hot"))
    wanted = hashes.join(counts, F.col("h") == F.col("h_all")).select("blk", "h", "hot")
    contexts = wanted.groupBy("blk").cogroup(dealt.groupBy(block)).applyInArrow(_contexts(id_col, raw, length, gram, shards), "shard int, h long, h2 long, nearest int, before binary, after binary, whole boolean, blk int, places binary")
    spans = contexts.groupBy("shard").applyInArrow(_settle(length, gram), "blk int, row_id long, start long, stop long")
    spans = spans.select(F.col("blk").alias("s_blk"), "row_id", "start", "stop")
    schema = T.StructType([*docs.schema.fields, T.StructField("kept_bytes", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in made[1:4]), T.StructField("kept_sha256", T.StringType())])
    return spans.groupBy("s_blk").cogroup(dealt.groupBy(block)).applyInArrow(_cut(id_col, raw, columns), schema)
