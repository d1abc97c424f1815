"""Language-model scores from a hashed maximum-entropy model.

The softmax over words is factored by classes twice. Every word has a class:
the most frequent training words have one each, the others share classes by a
hash of their ending; the words of a shared class are dealt to members by a
hash of the whole word. The probability of a token is that of its class given
what stands before, times that of its member given its class and what stands
before, both softmaxes over sums of weights of n-gram and skip features
(classes before and their pair, hashes of the word before and of the pair of
words before), times the word's add-one share of its member, with one place
for unknown words. The hashed tables grow with the counted vocabulary up to
``MOST_ROWS``.

Weights are trained over all training documents: each round takes its share of
them, every partition runs gradient steps from the weights so far, and the
mean of the partitions' changes is the round's update, so scores depend a
little on how many partitions the table has. Scoring runs in sparse numpy
batches.

Counts of words are exact and grow with the input, so they are never
broadcast: each block of documents gets back the counts of its own words. A
word's counts are summed in groups of blocks first, so that no word brings a
row of every block into one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import fresh, in_blocks, materialize, n_blocks

#: The end token; no word holds a space.
END = b" "
TOP, SHAPES = 24, 24
CLASSES = TOP + SHAPES
#: Members of a shared class.
MEMBERS = 16
#: Least and most hashed rows of the word before; the pair of words before has twice as many. One for ``ROW_WORDS`` words counted.
LEAST_ROWS, MOST_ROWS, ROW_WORDS = 4096, 32_768, 1024
ROUNDS = 4
BATCH = 16_384
#: Tokens of one gradient step.
STEP = 4_096
RATE = 0.2
#: Numbers of weights in one summed chunk.
CHUNK = 16_384
#: Learners whose changes of a chunk meet in one group.
TREE = 512
#: Bytes of training text for each learner; there are at least two for each core.
LEARN_BYTES = 256 << 20
#: Bytes of text in a block.
SCORE_BLOCK = 16 << 20
#: Blocks in one group of a word's counts.
GROUP_BLOCKS = 1024


_MARKS = np.isin(np.arange(256), list(b".,;:!?\"')"))


def word_codes(words: list[bytes], top: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Class and 32-bit hash of words, none empty. Words without a class of their own share one by their last two bytes before up to three marks, and whether there are marks."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    data, stop = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n)
    start = stop - n
    power = np.cumprod(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(start, n)], start)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    at = stop - 1
    for _ in range(3):
        at = at - (_MARKS[data[at]] & (at > start))
    ending = data[at] * np.uint32(257) + np.where(at > start, data[np.maximum(at - 1, 0)], 0).astype(np.uint32) * np.uint32(2) + (at < stop - 1)
    cls = TOP + ((ending * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % SHAPES
    if top:
        own = top.get
        short = max(map(len, top))
        for i in np.flatnonzero(n <= short).tolist():
            if (c := own(words[i])) is not None:
                cls[i] = c
    return cls, (h >> np.uint64(32)).astype(np.uint32)


def cell_of(cls: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of a word's (class, member); words with a class of their own have its first member."""
    return cls * MEMBERS + np.where(cls < TOP, 0, (hashes >> np.uint32(7)) % MEMBERS).astype(np.int64)


class _Vocabulary(dict):
    """Word -> number, filled as words come; ``classes`` and ``hashes`` by number, after ``settle``."""

    LIMIT = 1_000_000

    def __init__(self, top: dict[bytes, int]) -> None:
        super().__init__()
        self.top, self.new = top, []
        self.classes, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def settle(self) -> None:
        cls, hashes = word_codes(self.new, self.top)
        self.classes, self.hashes = np.append(self.classes, cls), np.append(self.hashes, hashes)
        self.new.clear()


@lru_cache(1)
def _vocabulary(top: tuple[bytes, ...]) -> list[_Vocabulary]:
    """The words a worker knows; rounds of training find those of the rounds before."""
    return [_Vocabulary({w: i for i, w in enumerate(top)})]


def _tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()  # bytes know ASCII case and white space only
    words.append(END)
    return words


class Model:
    """Weights. Classes: bias, class before, class before that (a skip), their pair, word before, pair of words before; members: the class, with the class before, with the word before. Class CLASSES is the start of a text."""

    def __init__(self, word_rows: int, flat: np.ndarray | None = None) -> None:
        c, self.word_rows = CLASSES + 1, word_rows
        shapes = [(1, CLASSES), (c, CLASSES), (c, CLASSES), (c * c, CLASSES), (word_rows, CLASSES), (2 * word_rows, CLASSES), (SHAPES, MEMBERS), (c * SHAPES, MEMBERS), (word_rows, MEMBERS)]
        ends = np.cumsum([a * b for a, b in shapes])
        self.flat = np.zeros(int(ends[-1]), np.float32) if flat is None else flat
        self.tables = [self.flat[e - a * b : e].reshape(a, b) for e, (a, b) in zip(ends, shapes, strict=True)]
        self.bias, self.one, self.two, self.pair, self.word, self.words, self.own, self.member, self.member_word = self.tables

    def context(self) -> np.ndarray:
        """Sums of bias, class before, skip and pair for every pair of classes."""
        return self.pair + (self.one[:, None] + self.two[None]).reshape(-1, CLASSES) + self.bias

    def classes(self, context: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Weights of the classes for each token; ``rows`` as from ``features``."""
        z = _take(context, rows[0])
        z += _take(self.word, rows[1])
        z += _take(self.words, rows[2])
        return z

    def members(self, cls: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Weights of the members for tokens in shared classes."""
        z = _take(self.member, rows[3])
        z += _take(self.own, cls - TOP)
        z += _take(self.member_word, rows[1])
        return z


def _take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at.astype(np.int64, copy=False), axis=0)


def _exp_sum(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``exp(z)`` in place and its row sums; weights beyond what single precision bears are shifted by each row's greatest first."""
    if len(z) and not (-60 < z.min() and z.max() < 60):
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, np.einsum("nk->n", z)


def log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row at ``at``; ``z`` is used up."""
    e, total = _exp_sum(z)
    return np.log(np.maximum(e[np.arange(len(e)), at], np.float32(1e-37)) / total)


def residual(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Softmax of each row, less one at ``at``: the gradient. ``z`` is used up."""
    e, total = _exp_sum(z)
    e *= (1 / total)[:, None]
    e[np.arange(len(e)), at] -= 1
    return e


def features(cls: np.ndarray, word: np.ndarray, starts: np.ndarray, word_rows: int) -> np.ndarray:
    """Active rows (4 x tokens) of consecutive texts: pair of classes, word, pair of words before, class before with own class; ``starts`` has each text's first position."""
    n = len(cls)
    c1, c2 = np.full(n, CLASSES), np.full(n, CLASSES)
    w1, w2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    c1[1:], w1[1:] = cls[:-1], word[:-1]
    c1[starts], w1[starts] = CLASSES, 0
    c2[1:], w2[1:] = c1[:-1], w1[:-1]
    c2[starts], w2[starts] = CLASSES, 0
    pair = (w1 * np.uint32(0x9E3779B1)) ^ (w2 * np.uint32(0x85EBCA77))
    spread = w1 * np.uint32(0xC2B2AE3D)
    cols = (c1 * (CLASSES + 1) + c2, (spread ^ (spread >> np.uint32(15))) % np.uint32(word_rows), (pair ^ (pair >> np.uint32(15))) % np.uint32(2 * word_rows), c1 * SHAPES + np.maximum(cls - TOP, 0))
    return np.stack([c.astype(np.uint16) for c in cols])


def _sums(keys: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows: first, second, ... rows of all keys at once, what then is left key by key."""
    order = np.argsort(keys, kind="stable")
    ids = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    count = np.diff(np.append(first, len(ids)))
    if len(first) * 8 < len(ids):
        return ids[first], np.add.reduceat(_take(grad, order), first, axis=0)
    total, live = _take(grad, order[first]), np.arange(len(first))
    for nth in range(1, 6):
        live = live[count[live] > nth]
        if not len(live):
            return ids[first], total
        total[live] += _take(grad, order[first[live] + nth])
    live = live[count[live] > 6]
    if len(live):
        more = count[live] - 6
        start = np.cumsum(more) - more
        total[live] += np.add.reduceat(_take(grad, order[np.repeat(first[live] + 6 - start, more) + np.arange(int(more.sum()))]), start, axis=0)
    return ids[first], total


class Learner:
    """Gradient steps on a copy of a model, with an adaptive rate for each row."""

    def __init__(self, model: Model) -> None:
        self.model = Model(model.word_rows, model.flat.copy())
        self.seen = [np.zeros(len(t), np.float32) for t in self.model.tables]

    def _move(self, table: int, at: np.ndarray | slice, total: np.ndarray) -> None:
        seen = self.seen[table][at] + np.einsum("nk,nk->n", total, total) / total.shape[1]
        self.seen[table][at] = seen
        total *= (RATE / np.sqrt(seen + 1e-6))[:, None]
        if isinstance(at, slice):
            self.model.tables[table][at] -= total
        else:
            self.model.tables[table][at] = _take(self.model.tables[table], at) - total

    def step(self, rows: np.ndarray, cls: np.ndarray, member: np.ndarray) -> None:
        m = self.model
        grad = residual(m.classes(m.context(), rows), cls)
        shared = np.flatnonzero(cls >= TOP)
        inner = residual(m.members(cls[shared], rows[:, shared]), member[shared])
        self._move(4, *_sums(rows[1], grad))
        self._move(5, *_sums(rows[2], grad))
        ids, total = _sums(rows[0], grad)
        # the classes' own rows and the bias gather what their pairs do
        square = np.zeros(((CLASSES + 1) ** 2, CLASSES), np.float32)
        square[ids] = total
        square = square.reshape(CLASSES + 1, CLASSES + 1, -1)
        self._move(3, ids, total)
        self._move(1, slice(None), square.sum(axis=1))
        self._move(2, slice(None), square.sum(axis=0))
        self._move(0, slice(None), square.sum(axis=(0, 1))[None])
        if len(shared):
            self._move(8, *_sums(rows[1, shared], inner))
            ids, total = _sums(rows[3, shared], inner)
            square = np.zeros(((CLASSES + 1) * SHAPES, MEMBERS), np.float32)
            square[ids] = total
            self._move(7, ids, total)
            self._move(6, slice(None), square.reshape(CLASSES + 1, SHAPES, -1).sum(axis=0))


def _train(model: Model, top: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(model)
        known = _vocabulary(tuple(sorted(top, key=top.get)))
        steps = 0
        texts, held = [], 0

        def learn() -> None:
            nonlocal steps, held
            if not texts:
                return
            lengths = np.array([len(x) for x in texts])
            ids = np.concatenate(texts)
            known[0].settle()
            cls, hashes = known[0].classes[ids], known[0].hashes[ids]
            rows, member = features(cls, hashes, np.cumsum(lengths) - lengths, model.word_rows), cell_of(cls, hashes) % MEMBERS
            for lo in range(0, len(ids), STEP):
                part = slice(lo, lo + STEP)
                learner.step(rows[:, part], cls[part], member[part])
                steps += 1
            texts.clear()
            held = 0

        for batch in batches:
            for text in batch.column(0):
                words = _tokens(text.as_py())
                texts.append(np.fromiter(map(known[0].__getitem__, words), np.int32, len(words)))
                held += len(words)
                if held >= 4 * BATCH or len(known[0]) >= _Vocabulary.LIMIT:
                    learn()
                if len(known[0]) >= _Vocabulary.LIMIT:
                    known[0] = _Vocabulary(top)
        learn()
        change = learner.model.flat - model.flat
        at = np.arange(0, len(change), CHUNK)
        blobs = [change[i : i + CHUNK].astype(np.float16).tobytes() for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array(blobs, pa.binary()), pa.array([int(steps > 0)] * len(at), pa.int64())], ["chunk", "change", "n"])

    return run


def _summed(kind: type):
    """Sum of the changes of a chunk (numbers of ``kind``) and of the partitions that had documents."""

    def run(table: pa.Table) -> pa.Table:
        total, n = np.zeros(0, np.float32), 0
        for blob, k in zip(table.column("change"), table.column("n").to_pylist(), strict=True):
            if k:
                x = np.frombuffer(blob.as_py(), kind).astype(np.float32)
                total, n = x if n == 0 else total + x, n + k
        return pa.table({"chunk": table.column("chunk")[:1], "change": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    return run


def mean_changes(changes: DataFrame, learners: int) -> DataFrame:
    """(chunk, change, n): sums of (chunk, part, change, n) rows of many learners, by a tree: groups of at most about ``TREE`` rows at every level."""
    width = max(1, -(-learners // TREE))
    kind = np.float16
    while width > 1:
        dealt = changes.withColumn("part", F.pmod("part", F.lit(width)))
        told = dealt.groupBy("chunk", "part").applyInArrow(_with_part(_summed(kind)), "chunk int, change binary, n long, part int")
        changes, width, kind = told.select("chunk", "part", "change", "n"), -(-width // TREE) if width > TREE else 1, np.float32
    return changes.groupBy("chunk").applyInArrow(_summed(kind), "chunk int, change binary, n long")


def _with_part(sum_: Callable[[pa.Table], pa.Table]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return sum_(table).append_column("part", pa.array([key[1].as_py()], pa.int32()))

    return run


def train_model(docs: DataFrame, top: dict[bytes, int], text: str, turn: str, counts: np.ndarray, words: int, learners: int = 1) -> Model:
    """The model after one pass over ``docs`` in ``ROUNDS`` rounds; ``turn`` has a document's round.

    Biases start at the shares of the training tokens that classes and members
    (``counts``, CLASSES x MEMBERS) have; ``words`` is the number of words
    counted, ``learners`` about that of the partitions of ``docs``.
    """
    rows = LEAST_ROWS
    while rows < MOST_ROWS and rows * ROW_WORDS < words:
        rows *= 2
    model = Model(rows)
    model.bias[0] = np.log((counts.sum(axis=1) + 1) / (counts.sum() + CLASSES))
    model.own[:] = np.log((counts[TOP:] + 1) / (counts[TOP:].sum(axis=1, keepdims=True) + MEMBERS))
    for r in range(ROUNDS):
        changes = docs.filter(F.col(turn) == r).select(text).mapInArrow(_train(model, top), "chunk int, change binary, n long")
        changes = changes.select("chunk", F.spark_partition_id().alias("part"), "change", "n")
        for row in mean_changes(changes, learners).filter("n > 0").collect():  # the model: a bounded size
            x = np.frombuffer(row["change"], np.float32) / row["n"]
            model.flat[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(x)] += x
    return model


def _count(text: str, train: str, block: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter[bytes]] = {}  # of the partition's blocks: each block lies in one partition
        for batch in batches:
            for raw, use, blk in zip(batch.column(text), batch.column(train).to_pylist(), batch.column(block).to_pylist(), strict=True):
                if (have := found.get(blk)) is None:
                    have = found[blk] = Counter()
                if use:
                    have.update(_tokens(raw.as_py()))
                else:
                    for w in set(_tokens(raw.as_py())):
                        have.setdefault(w, 0)
        while found:
            blk, have = found.popitem()
            yield pa.RecordBatch.from_arrays([pa.array([blk] * len(have), pa.int32()), pa.array(list(have), pa.binary()), pa.array(list(have.values()), pa.int64())], ["blk", "word", "n"])

    return run


def _score(columns: list[str], text: str, top: dict[bytes, int], model: Model, mass: np.ndarray, n_train: int, n_vocab: int):
    def run(counts: pa.Table, docs: pa.Table) -> pa.Table:
        context = model.context()
        words = counts.column("word").to_pylist() if counts.num_rows else []
        c = counts.column("c").to_numpy().astype(np.float64) if counts.num_rows else np.zeros(0)
        number = dict(zip(words, range(len(words)), strict=True))
        classes, hashes = word_codes(words, top)
        base = np.log10(c + 1) - np.log10(n_train + n_vocab + 1)
        cells = cell_of(classes, hashes)
        share = np.where(classes < TOP, 0.0, np.log10(c + 1) - np.log10(mass[cells] + 1))  # a class of one word is that word
        out: tuple[list, ...] = ([], [], [], [])
        held: list[np.ndarray] = []

        def finish() -> None:
            if not held:
                return
            lengths = np.array([len(x) for x in held])
            starts = np.cumsum(lengths) - lengths
            ids = np.concatenate(held)
            k = classes[ids]
            rows, member = features(k, hashes[ids], starts, model.word_rows), cells[ids] % MEMBERS
            logp = np.empty(len(ids))
            for lo in range(0, len(ids), BATCH):
                part = slice(lo, lo + BATCH)
                own = k[part]
                logp[part] = log_share(model.classes(context, rows[:, part]), own)
                shared = np.flatnonzero(own >= TOP)
                logp[lo + shared] += log_share(model.members(own[shared], rows[:, part][:, shared]), member[part][shared])
            logp = logp / np.log(10) + share[ids]
            for col, x in zip(out, (lengths, np.add.reduceat((c[ids] > 0).astype(np.int64), starts), np.add.reduceat(base[ids], starts), np.add.reduceat(logp, starts)), strict=True):
                col.append(x)
            held.clear()

        size = 0
        for raw in docs.column(text):
            tokens = _tokens(raw.as_py())
            ids = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
            held.append(ids)
            size += len(ids)
            if size >= 8 * BATCH:
                finish()
                size = 0
        finish()
        arrays = [np.concatenate(x) if x else np.zeros(0) for x in out]
        cols = [docs.column(name) for name in columns] + [pa.array(arrays[0].astype(np.int64)), pa.array(arrays[1].astype(np.int64)), pa.array(arrays[2].astype(np.float64)), pa.array(arrays[3].astype(np.float64))]
        return pa.table(cols, names=[*columns, "n_tokens", "n_known", "base_score", "score"])

    return run


def _totals(counted: DataFrame, groups: int) -> DataFrame:
    """(blk, word, c): ``c`` sums ``n`` over all blocks with the word, by groups of blocks first where there are several."""
    if groups <= 1:
        return counted.withColumn("c", F.sum("n").over(W.partitionBy("word"))).select("blk", "word", "c")
    grouped = counted.withColumn("g", F.pmod("blk", F.lit(groups)))
    parts = grouped.groupBy("word", "g").agg(F.sum("n").alias("n"))
    whole = parts.withColumn("c", F.sum("n").over(W.partitionBy("word"))).select("word", "g", "c")
    return grouped.join(whole, ["word", "g"]).select("blk", "word", "c")


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2):
    """Whether crc32 of the id as text leaves ``fold``; a null id is as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10 probability).

    A null, empty or blank text is its end token alone. Repeated rows are each
    trained on and scored. A null id counts as the empty text when folds are
    drawn. Other columns are not used. An empty table gives an empty result;
    without training documents every count is zero and the class model
    uniform.
    """
    block, raw, train, turn = fresh(docs.select(id_col, text_col), "lm_block", "lm_raw", "lm_train", "lm_turn")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias(raw), (~held_out(id_col, folds, fold)).alias(train))
    blocks = n_blocks(plain, raw, SCORE_BLOCK)
    dealt = in_blocks(plain, block, "doc_id", raw, blocks)
    counted = dealt.mapInArrow(_count(raw, train, block), "blk int, word binary, n long")
    known = materialize(_totals(counted, -(-blocks // GROUP_BLOCKS)))
    words = known.groupBy("word").agg(F.max("c").alias("c")).filter("c > 0")
    frequent = words.filter(F.col("word") != END).orderBy(F.desc("c"), "word").limit(TOP - 1).collect()
    top = {END: 0} | {bytes(r["word"]): i + 1 for i, r in enumerate(frequent)}

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = CLASSES * MEMBERS
        for b in batches:
            ws = b.column(0).to_pylist()
            k = cell_of(*word_codes(ws, top))
            n = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int32()), pa.array(np.bincount(k, n, cells).astype(np.int64)), pa.array(np.bincount(k, minlength=cells).astype(np.int64))], ["k", "n", "v"])

    mass, counts, n_train, n_vocab = np.zeros(CLASSES * MEMBERS), np.zeros(CLASSES * MEMBERS), 0, 0
    for r in words.mapInArrow(sizes, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # one row per class and member
        mass[r["k"]], counts[r["k"]] = r["n"] + r["v"], r["n"]
        n_train, n_vocab = n_train + r["n"], n_vocab + r["v"]
    # a learner sends a whole model's change each round, so there are not more learners than the text warrants
    n_learners = max(2 * docs.sparkSession.sparkContext.defaultParallelism, blocks * SCORE_BLOCK // LEARN_BYTES)
    learners = plain.filter(train).withColumn(turn, F.pmod(F.xxhash64("doc_id", raw), F.lit(ROUNDS))).coalesce(n_learners)
    model = train_model(learners, top, raw, turn, counts.reshape(CLASSES, MEMBERS), n_vocab, n_learners)
    scored = known.select("blk", "word", "c").groupBy("blk").cogroup(dealt.groupBy(block)).applyInArrow(_score(["doc_id", train], raw, top, model, mass, n_train, n_vocab), f"doc_id {docs.schema[id_col].dataType.simpleString()}, {train} boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col(train)).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
