"""SentencePiece encoding and decoding of merge-type vocabularies.

A text's symbols start as its characters; an agenda holds the adjacent pairs
whose concatenation is in the vocabulary, ordered by score and then by place.
The best pair is merged, its new neighbours enter the agenda, stale entries
are skipped. The agendas of many short chunks advance together as rows of an
array. Characters outside the vocabulary become byte pieces. No piece but runs
of the space mark holds that mark after its start, and none holds a line feed,
so no merge crosses them, and the agenda runs once per distinct chunk (space
marks and what follows them up to the next mark or line feed). What a chunk
becomes is remembered as ids, as their decimal text and as decoded text, and a
text is the concatenation of its chunks. Ids and text of every row come from
the agenda; the sentencepiece library encodes and decodes every batch too, and
a difference is an error.
"""

from __future__ import annotations

import array
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh

#: The space mark.
MARK = "▁"
#: Chunks a worker remembers; the memory starts anew beyond.
MEMO = 1_000_000
#: Characters of chunks whose agendas run together in arrays; longer ones have a heap each.
SHORT = 24
NEVER = np.iinfo(np.int32).max


#: What a chunk becomes: ids (bytes of native 32-bit integers), their decimals each followed by a space, the decoded text.
Made = tuple[bytes, str, str]


class PieceTokenizer(dict):
    """Encoder and decoder of one model; as a dict, the memory of chunks and what they become."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import re

        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.ranks = {self.pieces[i]: order[sp.get_score(i)] for i in plain}  # the agenda's order: highest score first
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.shown = ["" if i in self.silent else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.decimals = [f"{i} " for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary has pieces with the space mark after other characters")
        self._pair_table()
        # marks that no piece holds after a letter: no merge joins them to the word before
        self.apart = {c for c in ".,;:!?" if not any(x.isalpha() and y == c for p in self.ids for x, y in zip(p, p[1:], strict=False))}
        cut = "" if any("\n" in p for p in self.ids) else "\n"
        self.chunks = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|{cut}+" if cut else "")).findall

    def agenda(self, chunk: str) -> list[str]:
        """Pieces of ``chunk`` after all merges."""
        sym = list(chunk)
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.ranks.get
        heap = [(r, i, i + 1, both) for i, both in enumerate(map(str.__add__, sym, sym[1:])) if (r := rank(both)) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not sym[a] or after[a] != b or sym[a] + sym[b] != both:
                continue  # a part has been merged since
            sym[a], sym[b] = both, ""
            left, right = before[a], after[b]
            after[a] = right
            if right >= 0:
                before[right] = a
                wide = both + sym[right]
                if (r := rank(wide)) is not None:
                    heapq.heappush(heap, (r, a, right, wide))
            if left >= 0:
                wide = sym[left] + both
                if (r := rank(wide)) is not None:
                    heapq.heappush(heap, (r, left, a, wide))
        return [s for s in sym if s]

    def _pair_table(self) -> None:
        """Pairs of symbols that merge: sorted keys, ranks and merged ids. A symbol is a piece's id, or for other characters ``n`` + code point."""
        n = len(self.pieces)
        self.other, self.wide = n, n + 0x110000
        self.symbol = np.arange(n, self.wide, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        found = {}
        for piece, r in self.ranks.items():
            for k in range(1, len(piece)):
                parts = [self.ids.get(x, n + ord(x) if len(x) == 1 else None) for x in (piece[:k], piece[k:])]
                if None not in parts:
                    found[parts[0] * self.wide + parts[1]] = (r, self.ids[piece])
        keys = sorted(found)
        self.pair_keys = np.array([*keys, np.iinfo(np.int64).max])
        self.pair_ranks = np.array([*(found[k][0] for k in keys), NEVER], np.int32)
        self.pair_ids = np.array([*(found[k][1] for k in keys), -1], np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, its last place if the pair doesn't merge."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.wide + b, -1)
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, at, len(self.pair_keys) - 1)

    def agendas(self, chunks: list[str]) -> Iterator[tuple[bytes, bool]]:
        """Symbols of many short chunks after all merges, and whether all are pieces: a row of ranks is a chunk's agenda, and all chunks take their best pair together."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        width = int(size.max())
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        s = np.full((len(chunks), width), -1, np.int32)
        s[np.arange(width) < size[:, None]] = self.symbol[codes]
        r = np.full(s.shape, NEVER, np.int32)
        r[:, :-1] = self.pair_ranks[self._pairs(s[:, :-1], s[:, 1:])]
        out, live, col = np.empty_like(s), np.arange(len(chunks)), np.arange(width)
        while len(live):
            at = r.argmin(axis=1)  # the first of the best: ties go to the left
            on = r[np.arange(len(live)), at] < NEVER
            if not on.all():
                out[live[~on]] = s[~on]
                live, at, s, r = live[on], at[on], s[on], r[on]
            row, right = np.arange(len(live)), np.minimum(at + 1, width - 1)
            both = self.pair_ids[self._pairs(s[row, at], s[row, right])]
            shift = np.minimum(col + (col > at[:, None]), width - 1)
            s, r = np.take_along_axis(s, shift, 1), np.take_along_axis(r, shift, 1)
            s[:, -1], r[:, -1] = -1, NEVER
            s[row, at] = both
            r[row, at] = self.pair_ranks[self._pairs(both, np.where(at + 1 < width, s[row, right], -1))]
            left = np.flatnonzero(at > 0)
            r[left, at[left] - 1] = self.pair_ranks[self._pairs(s[left, at[left] - 1], both[left])]
        flat, stride = out.tobytes(), 4 * width
        for i, n, plain in zip(range(0, len(flat), stride), (out >= 0).sum(axis=1).tolist(), (out < self.other).all(axis=1).tolist(), strict=True):
            yield flat[i : i + 4 * n], plain

    def learn(self, chunks: set[str]) -> None:
        """Remember what the short ones among ``chunks``, none known yet, become; ``__missing__`` sees to the others."""
        if len(self) + len(chunks) > MEMO:
            self.clear()
        new = {c[:-1] if c[-1] in self.apart and c[-2:-1].isalpha() else c for c in chunks}
        short = sorted((c for c in new if 1 < len(c) <= SHORT and c not in self), key=len)
        decimal, shown = self.decimals.__getitem__, self.shown.__getitem__
        for lo in range(0, len(short), 8192):
            part = short[lo : lo + 8192]
            for chunk, (symbols, plain) in zip(part, self.agendas(part), strict=True):
                ids = array.array("i", symbols)
                if plain:
                    self[chunk] = (symbols, "".join(map(decimal, ids)), "".join(map(shown, ids)))
                else:
                    self[chunk] = self._made(self._fallback([self.pieces[x] if x < self.other else chr(x - self.other) for x in ids]))

    def _made(self, ids: array.array) -> Made:
        return ids.tobytes(), "".join(map(self.decimals.__getitem__, ids)), self._shown(ids)

    def _fallback(self, pieces: list[str]) -> array.array:
        """Ids of pieces, byte pieces for characters outside the vocabulary."""
        out = array.array("i")
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def __missing__(self, chunk: str) -> Made:
        if chunk[-1] in self.apart and chunk[-2:-1].isalpha():
            word, mark = self[chunk[:-1]], self[chunk[-1]]
            out = (word[0] + mark[0], word[1] + mark[1], word[2] + mark[2])
        else:
            out = self._made(self._fallback(self.agenda(chunk)))
        if len(self) >= MEMO:
            self.clear()
        self[chunk] = out
        return out

    def made(self, texts: list[str]) -> list[Made]:
        """Ids of each text with the end id, their decimals joined by spaces, and the decoded text; chunks not seen before run their agendas together."""
        split = [self.chunks(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = [list(map(self.get, s)) for s in split]
        new: set[str] = set()
        for s, found in zip(split, known, strict=True):
            if None in found:
                new.update(c for c, x in zip(s, found, strict=True) if x is None)
        self.learn(new)
        end, out = array.array("i", [self.end]).tobytes(), []
        for s, found in zip(split, known, strict=True):
            if None in found:
                found = [self[c] if x is None else x for c, x in zip(s, found, strict=True)]
            ids, shown, text = zip(*found, strict=True) if found else ((), (), ())
            text = "".join(text)
            out.append((b"".join(ids) + end, "".join(shown) + str(self.end), text[1:] if text[:1] == " " else text))
        return out

    def encode(self, text: str) -> list[int]:
        """Ids with the end id; the text is prefixed with a space mark unless empty."""
        return array.array("i", self.made([text])[0][0]).tolist()

    def _shown(self, ids: list[int] | array.array) -> str:
        """The pieces' text; runs of byte pieces are read as UTF-8."""
        shown, byte_of = self.shown, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            return "".join(map(shown.__getitem__, ids))
        parts, run = [], bytearray()
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(shown[i])
        parts.append(run.decode("utf-8", "replace"))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the first space is the prefix."""
        text = self._shown(ids)
        return text[1:] if text[:1] == " " else text

    def agreed(self, texts: list[str], made: list[Made]) -> list[bool]:
        """Whether the library makes the same ids of each text, and the same text of those ids."""
        theirs = self.library.encode(texts, add_eos=True, num_threads=1)
        back = self.library.decode(theirs, num_threads=1)
        return [array.array("i", ids).tobytes() == own and text == shown for ids, text, (own, _, shown) in zip(theirs, back, made, strict=True)]


@lru_cache(1)
def _tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def piece_tokens(docs: DataFrame, model: str, text_col: str = "text", with_ids: bool = True, strict: bool = True) -> DataFrame:
    """Columns of ``docs`` and ``token_ids`` (if ``with_ids``), ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``agrees``.

    ``agrees`` says that the library's ids and decoded text are the same as
    the agenda's, which the row carries. With ``strict``, a row on which they
    differ fails the job. Input columns of these names are replaced.

    A null text is encoded as the empty string: the end id alone. Rows are
    independent, so ties and repeated rows need no care. An empty table gives
    an empty result.
    """
    made = ["token_ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
    docs = docs.drop(*made)
    (raw,) = fresh(docs, "pt_text")
    names = docs.columns
    types = {"token_ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "agrees": T.BooleanType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(model)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for whole in batches:
            for batch in _parts(whole, raw):
                texts = [x or "" for x in batch.column(raw).to_pylist()]
                own = tok.made(texts)
                agrees = tok.agreed(texts, own)
                if strict and not all(agrees):
                    raise ValueError(f"the library encodes or decodes otherwise: {texts[agrees.index(False)][:200]!r}")
                out = {
                    "n_tokens": pa.array([len(x[0]) // 4 for x in own], pa.int64()),
                    "ids_sha256": pa.array([sha(x[1]) for x in own], pa.string()),
                    "decoded_sha256": pa.array([sha(x[2]) for x in own], pa.string()),
                    "agrees": pa.array(agrees, pa.bool_()),
                }
                if with_ids:
                    at = np.concatenate([[0], np.cumsum(out["n_tokens"].to_numpy())])
                    out["token_ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(x[0] for x in own), np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(out[c] for c in made)], names=[*names, *made])

    return docs.withColumn(raw, F.col(text_col)).mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, types[c]) for c in made)]))


def _parts(batch: pa.RecordBatch, text: str, rows: int = 256, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of few rows and little text, as ids take more room than the text; a long text is a slice of its own."""
    sizes = np.array([len(x) if (x := v.as_py()) else 0 for v in batch.column(text)], np.int64)
    lo = 0
    while lo < len(sizes):
        fits = int(np.searchsorted(np.cumsum(sizes[lo : lo + rows]), chars, "right"))
        hi = lo + max(1, fits)
        yield batch.slice(lo, hi - lo)
        lo = hi
