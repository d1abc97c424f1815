"""Least-cost repair of conversations by weighted CYK parsing.

A repaired conversation's role initials are ``(s?(ua)+)?``. The repair grammar
is in Chomsky normal form: its nonterminals (p, q) stand for what takes a
conversation from place p to place q of that expression (start, after s, after
u, after a); binary rules are (p, q) -> (p, r) (r, q), terminal rules are the
edits of a row. A cell holds, for each nonterminal over a span of rows, the
least (cost, audit); rows that are put in have no span, so every cell is closed
under insertion on both sides.

The rows of a conversation are parsed in blocks: the chart of a block is filled
bottom-up by span length over all splits, remembered by the rows' kinds. Cells of
blocks, of the parts that lie in different tasks, are combined with their neighbours,
spans doubling in length. There is a rule for every place between, so any split of
a span gives its cell, and long conversations cost in proportion to their length.

Two audits of one cell with the same cost are never prefixes of one another
(the rest would be insertions, which cost), so the least of a span is made of
the least of its parts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

Cell = dict[tuple[int, int], tuple[int, str]]

START, SYSTEM, USER, AGENT = range(4)
#: Places that a row of this initial leads from and to.
MOVES = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (AGENT, USER)), "a": ((USER, AGENT),)}
KEEP, REROLE, INSERT, DELETE, UNFINISHED = 0, 2, 2, 3, 1
#: Rows whose chart is filled over all splits.
BLOCK = 16
#: Words for the places in repaired rows.
ROLES = ("user", "assistant")
SPACES = r"\x20\x09-\x0D"


# -- cells ------------------------------------------------------------------


def combine(left: Cell, right: Cell) -> Cell:
    """(p, q) -> (p, r) (r, q): the least (cost, audit) over r."""
    out: Cell = {}
    for (p, r), (c1, a1) in left.items():
        for (r2, q), (c2, a2) in right.items():
            if r == r2 and ((have := out.get((p, q))) is None or c1 + c2 < have[0] or (c1 + c2 == have[0] and a1 + a2 < have[1])):
                out[p, q] = (c1 + c2, a1 + a2)
    return out


def least(*cells: Cell) -> Cell:
    out: Cell = {}
    for cell in cells:
        for pq, found in cell.items():
            out[pq] = min(out.get(pq, found), found)
    return out


@lru_cache(1)
def insertions() -> Cell:
    """The cell of no rows: rows put in until nothing gets less."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    once: Cell = {move: (INSERT, "I") for initial in "ua" for move in MOVES[initial]}
    while (more := least(cell, combine(cell, once))) != cell:
        cell = more
    return cell


@lru_cache(64)
def terminal(kind: str) -> Cell:
    """The cell of one row. Kinds: ``D`` must go; else the initial, ``o`` for any other, in upper case if the text is unfinished."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "D":
        extra = UNFINISHED * kind.isupper()
        rerole: Cell = {move: (REROLE + extra, "R") for initial in "ua" for move in MOVES[initial]}
        cell = least(cell, rerole, {move: (KEEP + extra, "K") for move in MOVES.get(kind.lower(), ())})
    return combine(insertions(), combine(cell, insertions()))


@lru_cache(100_000)
def chart(kinds: str) -> Cell:
    """The cell of a span of rows: all spans by length, each over all its splits."""
    n = len(kinds)
    cells = {(i, i + 1): terminal(x) for i, x in enumerate(kinds)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells[i, i + length] = reduce(least, (combine(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)))
    return cells[0, n]


def joined(cells: list[Cell]) -> Cell:
    """Neighbours combined, spans doubling in length."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else insertions()


def parse(kinds: str) -> Cell:
    return joined([chart(kinds[i : i + BLOCK]) for i in range(0, len(kinds), BLOCK)])


def verdict(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the cheapest repair: nothing left, or all of ``s?(ua)+``."""
    return min(cell[START, START], cell[START, AGENT])


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation; the number of its rows tells whether it begins with a system row."""
    n = sum(x != "D" for x in audit)
    at = -(n % 2)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            yield (role if edit == "K" else ROLES[at % 2]), text
            at += 1


# -- rows -------------------------------------------------------------------


def damaged(talk: DataFrame) -> DataFrame:
    """``talk`` (conv_id, turn, role, text) with the contract's faults: crc32 of ``conv_id:turn`` by 20 drops (0), empties (1), loses full stops (2), repeats (3) or makes a user's (4). Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    hurt = talk.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), draw.alias("draw")).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


_PART = pa.schema(
    [("conv_id", pa.int64()), ("first_turn", pa.int64()), ("first_role", pa.string()), ("first_digest", pa.binary()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string())]
    + [(c, pa.int64()) for c in ("min_turn", "max_turn", "n_turns", "blank", "duplicate", "truncated", "illegal")]
    + [("cells", pa.string())]
)
_LEGAL = {"su", "ua", "au"}


def _packed(cell: Cell) -> str:
    return json.dumps([[*pq, *found] for pq, found in cell.items()])


def _unpacked(cell: str) -> Cell:
    return {(p, q): (cost, audit) for p, q, cost, audit in json.loads(cell)}


class _Part:
    """What is known of the consecutive rows of a conversation in one task."""

    def __init__(self, conv: int | None, turn: int | None, role: str, digest: bytes, initial: str) -> None:
        self.head = (conv, turn, role, digest)
        self.first_initial, self.initial, self.turn = initial, None, None
        self.low = self.high = None
        self.counts = {c: 0 for c in ("n_turns", "blank", "duplicate", "truncated", "illegal")}
        self.cells: list[Cell] = []
        self.kinds: list[str] = []

    def add(self, turn: int | None, initial: str, blank: bool, unfinished: bool, later: bool, n: int) -> None:
        c = self.counts
        if turn is not None:
            c["n_turns"] += turn != self.turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.turn = turn
        c["illegal"] += (self.initial is not None and self.initial + initial not in _LEGAL) + (n - 1) * (initial * 2 not in _LEGAL)
        self.initial = initial
        first = not blank and not later
        c["blank"] += n * blank
        c["duplicate"] += 0 if blank else n - first
        c["truncated"] += first and unfinished
        kind = initial if initial in MOVES else "o"
        if first:
            self.kinds.append(kind.upper() if unfinished else kind)
        self.kinds += "D" * (n - first)
        if len(self.kinds) >= 4096:
            self.cells.append(parse("".join(self.kinds)))
            self.kinds = []

    def row(self) -> tuple:
        cell = joined([*self.cells, *([parse("".join(self.kinds))] if self.kinds else [])])
        c = self.counts
        return (*self.head, self.turn, self.first_initial, self.initial, self.low, self.high, c["n_turns"], c["blank"], c["duplicate"], c["truncated"], c["illegal"], _packed(cell))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (conv, turn, role, digest, initial, blank, unfinished, later, n): one row for each conversation that has rows in this task."""
    part, out = None, []
    told = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_PART)], schema=_PART)
    for batch in batches:
        for conv, turn, role, digest, initial, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part is None or part.head[0] != conv:
                if part is not None:
                    out.append(part.row())
                    if len(out) >= 1000:
                        yield told()
                        out = []
                part = _Part(conv, turn, role, digest, initial)
            part.add(turn, initial, *rest)
    if part is not None:
        out.append(part.row())
    if out:
        yield told()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations, in order, as their numbers and the cheapest repair."""
    for batch in batches:
        rows = []
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            turns = [(p["min_turn"], p["max_turn"]) for p in parts if p["min_turn"] is not None]
            n_turns, illegal = sum(p["n_turns"] for p in parts), sum(p["illegal"] for p in parts)
            for a, b in zip(parts, parts[1:], strict=False):
                n_turns -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
                illegal += a["last_initial"] + b["first_initial"] not in _LEGAL
            cost, audit = verdict(joined([_unpacked(p["cells"]) for p in parts]))
            gaps = turns[-1][1] - turns[0][0] + 1 - n_turns if turns else 0
            rows.append((conv, gaps, *(sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")), illegal, cost, audit))
        types = [pa.int64()] * 7 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", *_NUMBERS, "audit"])


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _told(rows: DataFrame) -> DataFrame:
    """Rows with the digest that orders those of one turn."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def repairs(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn (nulls first), then role, then the SHA-256 of the
    text; a null role or text is one space. A role whose initial is not s, u or
    a, or that is empty, can't be kept. A null conv_id is a conversation of its
    own. Repeated rows are duplicates. No rows, no conversations.

    Equal rows are counted together first and a row is a later one by the least
    turn of its role and text, so neither is a group in a task; the rows are
    dealt by ranges of conversation and turn, so a long conversation lies in many.
    """
    text = F.col("text")
    blank = ~text.rlike(f"[^{SPACES}]")
    small = _told(rows).select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~blank & ~text.rlike(f"[.!?][{SPACES}]*\\z")).alias("unfinished"))
    counted = materialize(small.groupBy(*small.columns).agg(F.count("*").alias("n")))
    seen = counted.groupBy(F.col("conv_id").alias("s_conv"), F.col("role").alias("s_role"), F.col("digest").alias("s_digest")).agg(F.min(F.struct("turn")).alias("s_first"))
    at = F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("role") == F.col("s_role")) & (F.col("digest") == F.col("s_digest"))
    later = ~F.col("turn").eqNullSafe(F.col("s_first.turn"))
    flagged = materialize(counted.join(seen, at).select("conv_id", "turn", "role", "digest", "initial", "blank", "unfinished", later.alias("later"), "n"))
    order = ["conv_id", "turn", "role", "digest"]
    schema = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in _PART)
    parts = flagged.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_parts, schema)
    return parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*[f.name for f in _PART if f.name != "conv_id"])))).mapInArrow(_folded, _FOUND)


def _with_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's repair followed by its rows, in order, in one task: texts only stream past."""
    heads = found.select("conv_id", *_NUMBERS, "audit", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest"))
    body = _told(rows).select("conv_id", *(F.lit(None).cast("long").alias(c) for c in _NUMBERS), F.lit(None).cast("string").alias("audit"), F.lit(1).alias("part"), "turn", "role", "text", "digest")
    return heads.unionAll(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest").drop("digest", "turn")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """(head, rows) of each conversation; rows are read as they are asked for."""
    each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    ahead = [next(each, None)]

    def body() -> Iterator[tuple[str, str]]:
        while (row := next(each, None)) is not None and row[8] == 1:
            yield row[9], row[10]
        ahead[0] = row

    while ahead[0] is not None:
        head, ahead[0] = ahead[0], None
        rows = body()
        yield head, rows
        for _ in rows:
            pass


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for head, rows in _streamed(batches):
        sha, between = hashlib.sha256(), b""
        for role, text in repaired(head[7], rows):
            sha.update(between + f"{role}:{text}".encode())
            between = b"\n"
        out.append((*head[:8], sha.hexdigest()))
    types = [pa.int64()] * 7 + [pa.string()] * 2
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["conv_id", *_NUMBERS, "audit", "repaired_sha256"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, rows in _streamed(batches):
        said = list(repaired(head[7], rows))
        yield pa.RecordBatch.from_arrays([pa.array([head[0]] * len(said), pa.int64()), pa.array(range(len(said)), pa.int64()), pa.array([r for r, _ in said], pa.string()), pa.array([t for _, t in said], pa.string())], ["conv_id", "position", "role", "text"])


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text."""
    rows = materialize(rows.select("conv_id", "turn", "role", "text"))
    return _with_texts(rows, repairs(rows)).mapInArrow(_rebuilt, "conv_id long, position long, role string, text string")


def repair_report(talk: DataFrame, damage: bool = True) -> DataFrame:
    """A row for every conv_id of ``talk``: ``repairs`` of its rows, after the contract's damage, and the SHA-256 of the repaired ``role:text`` lines.

    A conversation that damage leaves without rows has zeros, an empty audit
    and the hash of nothing; an empty table gives an empty result. Further columns are
    not used, so their names can't clash.
    """
    talk = talk.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = damaged(talk) if damage else talk
    found = repairs(rows).withColumnRenamed("conv_id", "f_conv")
    every = talk.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left")
    every = every.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in _NUMBERS), F.coalesce("audit", F.lit("")).alias("audit"))
    return _with_texts(rows, every).mapInArrow(_hashed, f"{_FOUND}, repaired_sha256 string")
