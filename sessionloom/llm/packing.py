"""Best-fit packing of token pieces through a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the
driver. The configuration program (fewest sequences whose multisets of
lengths cover the histogram) is solved by multiplicative weights: each length
has a price, a knapsack dynamic program finds the dearest configurations at
these prices, and the weights of the lengths these cover fall. The best prices
seen, single or averaged, prove a lower bound on the number of sequences. The
program is then rounded: configurations are priced anew by the knapsack, around
the longest pieces left, with weights that fall with what is covered, and taken
for whole numbers of sequences until all pieces are in one. Of a few such
roundings the shortest counts; pieces of the emptiest sequences, a tenth of all at
most, are packed once more by best fit. The plan is a table of slots, bounded by
the number of configurations. Pieces find their slot by their rank within their length,
counted in salted groups so that no length is one task.
"""

from __future__ import annotations

import array
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize

CAPACITY = 1024
END_ID = 2
#: Where the library cuts words, for texts of ``SURE`` characters only: there letters are word characters without digits and the low line, and numbers are decimal digits.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Inside of a character class: ASCII without the separators 1C to 1F, Latin-1 without next line and numbers, Latin, Greek and Cyrillic letters, dashes and quotes, the euro, kana, Han, Hangul.
SURE = "\x00-\x1b\x20-\x7f\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Words a worker remembers, and their greatest length; the memory starts anew beyond.
MEMO, REMEMBERED = 1_000_000, 64
#: Characters of texts that are encoded together.
ENCODED = 1 << 20
#: Pieces of one length that one group ranks.
RANK_ROWS = 20_000
#: Ways of rounding the program, see ``round_configurations``: favour, anchors, share, rate.
ROUNDINGS = ((0.5, 4, 1.0, 0.0), (0.2, 64, 0.5, 0.0))
#: Tokens of waste beyond which sequences are dissolved, and the part of all pieces that may then be packed by best fit: one in so many.
WASTE, REMAINDER = (200, 64, 8, 0), 10
#: Steps of the weights, and the gap between bound and plan at which they end.
PASSES, GAP = 300, 0.002

Plan = list[tuple[list[tuple[int, int]], int]]


# -- tokens -----------------------------------------------------------------


class _Encoder(dict):
    """Ids of texts by the ``tokenizers`` library with its default settings: added tokens of the file are found inside texts, none are put around them.

    The library first cuts a text into words and encodes each by itself, so
    words are encoded once and remembered: as a dict, the memory of words and
    their ids (little-endian unsigned 32-bit bytes). Texts whose cuts this
    class doesn't know for certain go to the library whole: those with an added
    token, and those with characters beyond ``SURE``. So do all texts if the
    file cuts otherwise than at its bytes' words.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import json
        import os
        import re
        from pathlib import Path

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        cut = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and made.get("post_processor") is None and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        self.words = re.compile(WORDS).findall
        self.odd = re.compile(f"[^{SURE}]").search
        added = [t["content"] for t in made.get("added_tokens", ())]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes, ``ENCODED`` characters or one text at a time."""
        lo = size = 0
        for hi, text in enumerate(texts):
            if size and size + len(text) > ENCODED:
                yield from self._encode(texts[lo:hi])
                lo, size = hi, 0
            size += len(text)
        yield from self._encode(texts[lo:])

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        known: list[list[bytes | None] | None] = []
        new: set[str] = set()
        split: list[list[str]] = []
        for text in texts:
            whole = not self.cuts or self.odd(text) is not None or self.added(text) is not None
            split.append([] if whole else self.words(text))
            known.append(None if whole else list(map(self.get, split[-1])))
            if not whole and None in known[-1]:
                new.update(w for w, x in zip(split[-1], known[-1], strict=True) if x is None)
        fresh_ = dict(zip(new, self._by_library(list(new)), strict=True))
        others = self._by_library([t for t, own in zip(texts, known, strict=True) if own is None])
        for words, own in zip(split, known, strict=True):
            if own is None:
                yield next(others)
            elif None in own:
                yield b"".join([fresh_[w] if x is None else x for w, x in zip(words, own, strict=True)])
            else:
                yield b"".join(own)
        if len(self) + len(fresh_) > MEMO:
            self.clear()
        self.update((w, x) for w, x in fresh_.items() if len(w) <= REMEMBERED)

    def _by_library(self, texts: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(texts), 4096):
            for found in self.library.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False):
                ids = array.array("I", found.ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                yield ids.tobytes()


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut into pieces.

    Only documents longer than ``capacity`` are cut; all pieces but the first
    are then of full length. A null or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _encoder(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, own in zip(batch.column(0).to_pylist(), ids(texts), strict=True):
                tokens = memoryview(own + end)
                n = len(tokens) // 4
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
                    for col, x in zip(out, (doc, i, lo, hi - lo, zlib.crc32(tokens[4 * lo : 4 * hi])), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# -- the plan ---------------------------------------------------------------


def _price_table(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over all capacities: the greatest price that fits, and the length it takes last (-1: a token of waste)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            gains = best[c - lengths[: upto[c]]] + prices[: upto[c]]
            j = int(gains.argmax())
            if gains[j] > best[c]:
                best[c], took[c] = gains[j], j
    return best, took


def _configuration(j: int, lengths: np.ndarray, took: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Copies by length of the dearest configuration with length ``j`` in it, within ``most`` copies of each."""
    copies, c = {j: 1}, capacity - int(lengths[j])
    while c > 0:
        i = int(took[c])
        if i >= 0 and copies.get(i, 0) < most[i]:
            copies[i] = copies.get(i, 0) + 1
            c -= int(lengths[i])
        else:
            c -= 1
    return copies


def dual_prices(lengths: np.ndarray, demand: np.ndarray, capacity: int, passes: int = PASSES, goal: float = np.inf) -> tuple[np.ndarray, float]:
    """Prices of the lengths at which no configuration is worth more than 1, and the bound they prove: the demand's worth.

    Starts at a length's share of a sequence. In each step the dearest
    configurations around every length are found by one knapsack table, and the
    weights of the lengths fall exponentially by how much of their demand these
    cover. Any prices, divided by the dearest configuration's, prove a bound;
    those of single steps and their averages are tried. Ends within ``GAP`` of
    ``goal``.
    """
    d = demand.astype(float)
    logw = np.log(lengths / capacity)
    total, bound, prices = np.zeros(len(lengths)), -1.0, logw
    for t in range(passes):
        y = np.exp(logw - logw.max())
        y /= d @ y
        best, took = _price_table(lengths, y, capacity)
        total += y
        tried = [(y, best)]
        if t % 5 == 4:
            tried.append((total, _price_table(lengths, total, capacity)[0]))
        for p, table in tried:
            if (worth := float(d @ p / table[capacity])) > bound:
                bound, prices = worth, p / table[capacity]
        if bound >= goal * (1 - GAP):
            break
        if t in (19, 59, 139):  # the first steps' prices are far off
            total[:] = 0
        around = y + best[capacity - lengths]
        gain = np.zeros(len(lengths))
        for j in np.flatnonzero(around >= 0.98 * best[capacity]):
            copies = _configuration(int(j), lengths, took, demand, capacity)
            i, m = np.fromiter(copies, np.int64), np.fromiter(copies.values(), float)
            gain[i] += m / d[i] * (d[i] / m).min()
        logw -= 0.5 / np.sqrt(1 + t / 4) * gain / gain.max()
    return prices, bound


def round_configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, prices: np.ndarray, favour: float, anchors: int, share: float, rate: float) -> Plan:
    """Configurations with whole numbers of sequences that cover ``demand`` exactly.

    The weight of a length falls exponentially, at ``rate``, as its demand is
    covered; its price is that of ``prices`` times the weight, and long pieces
    are worth up to ``favour`` more, so that short ones are left to fill gaps.
    One knapsack table gives the dearest configuration around each of the
    ``anchors`` longest lengths left; each is taken for the share ``share`` of the
    sequences that its scarcest length allows, rounded down, one at least. A
    configuration that lacks a length the table counted on waits for the next
    table.
    """
    rest = demand.copy()
    plan: Plan = []
    while (live := np.flatnonzero(rest)).size:
        size, left = lengths[live], rest[live]
        value = prices[live] * (1 + favour * size / capacity) * np.exp(-rate * (1 - left / demand[live]))
        best, took = _price_table(size, value, capacity)
        taken = 0
        for j in range(len(live) - 1, -1, -1):
            if left[j] <= 0:
                continue
            copies = _configuration(j, size, took, left, capacity)
            if taken and sum(value[i] * m for i, m in copies.items()) < value[j] + best[capacity - size[j]] - 1e-9:
                break
            n = max(1, int(min(int(left[i]) // m for i, m in copies.items()) * share))
            plan.append(([(int(size[i]), m) for i, m in copies.items()], n))
            for i, m in copies.items():
                left[i] -= m * n
            taken += 1
            if taken == anchors:
                break
        rest[live] = left
    return plan


def sequences(plan: Plan) -> int:
    return sum(n for _, n in plan)


def pieces_of(plan: Plan) -> dict[int, int]:
    out: dict[int, int] = {}
    for config, n in plan:
        for size, m in config:
            out[size] = out.get(size, 0) + m * n
    return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, passes: int = PASSES) -> tuple[Plan, float, int]:
    """(configuration as (length, copies), number of sequences) for all pieces of ``histogram``, a number of sequences that no plan can undercut, and the pieces of the remainder.

    Every plan that is considered is one of the program: ``ROUNDINGS`` ways of
    rounding it, and for each the emptiest sequences, with at most a
    ``REMAINDER``-th of all pieces, dissolved and their pieces packed by best
    fit. The shortest counts. With ``passes`` 1 prices stay at the lengths'
    shares of a sequence.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    whole: Plan = [([(capacity, 1)], left.pop(capacity))] if capacity in left else []
    if not left:
        return whole, float(sequences(whole)), 0
    lengths = np.array(sorted(left), np.int64)
    demand = np.array([left[int(x)] for x in lengths], np.int64)
    prices, bound = dual_prices(lengths, demand, capacity, passes, sequences(_best_fit(left, capacity)))
    found: list[tuple[int, int, Plan]] = []
    for setting in ROUNDINGS:
        plan = round_configurations(lengths, demand, capacity, prices, *setting)
        filled = [sum(size * m for size, m in config) for config, _ in plan]
        for waste in (capacity, *WASTE):
            kept = [x for x, size in zip(plan, filled, strict=True) if capacity - size <= waste]
            loose = pieces_of([x for x, size in zip(plan, filled, strict=True) if capacity - size > waste])
            if sum(loose.values()) * REMAINDER <= demand.sum():
                once_more = kept + _best_fit(loose, capacity)
                found.append((sequences(once_more), sum(loose.values()), once_more))
    _, remainder, plan = min(found, key=lambda x: x[:2])
    return whole + plan, sequences(whole) + bound, remainder


def _best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Longest first, each into the fullest sequence with room; equal sequences are kept as one with a count."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # room: (configuration, count)
    done = []
    for size in sorted(left, reverse=True):
        todo = left[size]
        while todo:
            room = min((r for r, have in open_.items() if r >= size and have), default=None)
            if room is None:
                config, n, room = (), todo // max(1, capacity // size) or 1, capacity
            else:
                config, n = open_[room].pop()
            k = min(room // size, max(1, todo // n))
            n, spare = min(n, todo // k), n
            if room != capacity and spare > n:
                open_[room].append((config, spare - n))
            todo -= k * n
            open_.setdefault(room - k * size, []).append(((*config, (size, k)), n))
    for have in open_.values():
        done += [(list(config), n) for config, n in have]
    return done


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """Rows (length, rank of the first piece, copies, first sequence, offset) sorted by length and rank."""
    at: dict[int, int] = {}
    rows, first = [], 0
    for config, n in plan:
        offset = 0
        for size, copies in config:
            rows.append((size, at.get(size, 0), copies, first, offset))
            at[size] = at.get(size, 0) + copies * n
            offset += size * copies
        first += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    Every piece gets a place of its own; a sequence's pieces follow one
    another from 0 without gaps. Pieces of equal length are interchangeable:
    ties and repeated rows are ranked in any order. No pieces, no rows.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = slots(plan_sequences(histogram, capacity)[0])
    sizes = sorted(histogram)
    start = dict(zip(sizes, np.concatenate([[0], np.cumsum([histogram[x] for x in sizes])[:-1]]).astype(int).tolist() if sizes else [], strict=True))
    bins = spark.createDataFrame([(x, start[x], -(-histogram[x] // RANK_ROWS)) for x in sizes], "b_length long, b_start long, b_salts long")
    salted = pieces.join(F.broadcast(bins), F.col("length") == F.col("b_length")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("b_salts")))
    counts = salted.groupBy("length", "salt").count()
    offsets = counts.select(F.col("length").alias("o_length"), F.col("salt").alias("o_salt"), (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("o_before"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(offsets, (F.col("length") == F.col("o_length")) & (F.col("salt") == F.col("o_salt"))).withColumn("rank", F.col("rank") + F.col("o_before"))
    bounds = np.array([start[int(x)] for x in table["length"]], np.int64) + table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, base = (batch.column(c).to_numpy() for c in ("length", "rank", "b_start"))
            at = np.searchsorted(bounds, base + rank, "right") - 1
            nth = rank - table["rank"][at]
            seq, off = table["sequence"][at] + nth // table["copies"][at], table["offset"][at] + nth % table["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "b_start").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece.

    A null or empty text is a piece of one token. Repeated rows are packed
    each. A null id stays null. Other columns are not used, so their names
    can't clash. An empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, capacity, id_col, text_col), capacity)
