"""Packing of documents into training sequences by vector bin packing.

Every partition packs its own documents in one pass, with a bounded number of open sequences. Whole
documents (or what is left of long ones after full sequences are cut off) are placed by the dot-product
heuristic: of the open sequences whose limits on tokens, segments and loss-bearing tokens all hold, the
one with the largest dot product of remaining capacity and demand takes the piece. When the open
sequences are full up to a limit, the fullest is topped up with a cut piece and closed. What stays open
at the end of a partition is joined and cut into sequences of power-of-two lengths, which need no
padding. Nothing is shuffled and no two partitions share a sequence.

Defined results: null text counts as empty, so the document is its end token alone; repeated rows are
packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END = 2
LENGTH = 4096
#: Distinct pieces whose ids a worker remembers; beyond it the memory starts anew (ids stay the same).
MEMORY = 500_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The byte-level alphabet: printable bytes stand for themselves, the others for what follows 255.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_PIECE = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff\x20\t\n\r\v\f]+")
_PLAIN = bytes(c for c in range(128) if not 0x1C <= c < 0x20 and c != ord("'"))


def pieces(text: bytes) -> list[bytes]:
    """Parts of a text that the tokenizer encodes independently of each other.

    It drops white space, and no token spans it. Where all other characters are ASCII (no apostrophe, which
    starts contractions) or letters, it also splits at each change between letters, digits and the rest.
    """
    small = text.translate(_LOWER)
    if b"<|" not in small and all(c.isalpha() and c.lower().isalpha() for c in set(text.translate(None, _PLAIN).decode())):
        return _PIECE.findall(small)
    return text.split()


class PieceIds:
    """Token ids of texts, by a memory of their pieces' ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merges = self.model.model
        self.direct = all(self._merged(w) == self._encoded([w])[0] for w in ("a", "thouonatedor", "éauxßñ", "ночь", "漢字"))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _encoded(self, new: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(new, add_special_tokens=False)]

    def _merged(self, word: str) -> list[int]:
        """Ids of a word that normalization and splitting leave as it is: the model alone gives them."""
        return [t.id for t in self.merges.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET))]

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode() for w in new]
        plain = [self.direct and t.isalpha() and t == t.lower() and is_normalized("NFC", t) for t in texts]
        rest = iter(self._encoded([t for t, p in zip(texts, plain) if not p]))
        got = [self._merged(t) if p else next(rest) for t, p in zip(texts, plain)]
        flat = np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        size = len(self.known)
        while size + len(new) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(len(self.first), np.int64)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[size + 1 : size + len(new) + 1] = self.used + np.cumsum([len(x) for x in got])
        self.known.update(zip(new, range(size, size + len(new))))
        self.used += len(flat)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        own = [pieces(t) for t in texts]
        new = set().union(*own).difference(self.known)
        if new and len(self.known) + len(new) > MEMORY:
            self._clear()
            new = set().union(*own)
        if new:
            self._learn(list(new))
        sizes = [len(x) for x in own]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(own)), np.int64, sum(sizes))
        low = self.first[at]
        n = self.first[at + 1] - low
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(low - ends[:-1], n) + np.arange(ends[-1])]
        return np.split(flat, ends[np.cumsum(sizes[:-1])]) if len(own) > 1 else [flat] * len(own)


_loaded: dict[str, PieceIds] = {}


def _ids_of(path: str) -> PieceIds:
    if path not in _loaded:
        _loaded[path] = PieceIds(path)
    return _loaded[path]


@dataclass
class Bin:
    number: int
    room: int
    segments: int
    loss: int
    pieces: list[tuple] = field(default_factory=list)


class Packer:
    """Places pieces (document, start, length, loss tokens) into sequences; `emit` gets each closed Bin."""

    def __init__(self, length: int, max_segments: int, max_loss: int, open_bins: int, base: int, emit: Callable[[Bin], None]):
        self.limits, self.most, self.emit = (length, max_segments, max_loss), open_bins, emit
        self.next, self.bins = base, []
        self.scale = [length**-2, max_segments**-2, max_loss**-2]

    def new(self) -> Bin:
        self.next += 1
        return Bin(self.next - 1, *self.limits)

    def close(self, b: Bin) -> None:
        self.bins = [x for x in self.bins if x is not b]
        self.emit(b)

    @staticmethod
    def put(b: Bin, doc: object, start: int, n: int, loss: int) -> None:
        b.pieces.append((doc, start, n, loss))
        b.room, b.segments, b.loss = b.room - n, b.segments - 1, b.loss - loss

    def add(self, doc: object, n: int, loss_of: Callable[[int, int], int]) -> None:
        """loss_of(start, length): the loss-bearing tokens of that part of the document."""
        start, full = 0, self.limits[0]
        while n - start >= full and loss_of(start, full) <= self.limits[2]:  # full sequences of this document alone
            b = self.new()
            self.put(b, doc, start, full, loss_of(start, full))
            self.emit(b)
            start += full
        while start < n:
            rest = n - start
            loss = loss_of(start, rest)
            fit = [b for b in self.bins if b.room >= rest and b.loss >= loss]
            if fit:
                x, y, z = rest * self.scale[0], self.scale[1], loss * self.scale[2]
                best = max(fit, key=lambda b: b.room * x + b.segments * y + b.loss * z)
                self.put(best, doc, start, rest, loss)
                if not (best.room and best.segments and best.loss):
                    self.close(best)
                return
            if len(self.bins) < self.most:
                b = self.new()
                self.bins.append(b)
                take = min(rest, b.room)
            else:  # top the fullest sequence up with a cut piece
                b = min(self.bins, key=lambda x: x.room)
                take = min(rest, b.room)
            while take > 1 and loss_of(start, take) > b.loss:
                take = max(1, take // 2)
            if loss_of(start, take) > b.loss:
                self.close(b)
                continue
            self.put(b, doc, start, take, loss_of(start, take))
            start += take
            if not (b.room and b.segments and b.loss) or len(self.bins) >= self.most and start < n:
                self.close(b)

    def finish(self) -> None:
        """Cut what is open into full sequences and powers of two."""
        pieces = [p for b in sorted(self.bins, key=lambda b: b.number) for p in b.pieces]
        self.bins, left = [], sum(p[2] for p in pieces)
        queue = pieces[::-1]
        while left:
            room = min(self.limits[0], 1 << (left.bit_length() - 1))
            b = self.new()
            b.room = room
            while b.room and b.segments and queue:
                doc, start, n, loss = queue.pop()
                take = min(n, b.room)
                if loss:  # every token of a piece bears loss, or none does
                    take = min(take, b.loss)
                if not take:
                    queue.append((doc, start, n, loss))
                    break
                self.put(b, doc, start, take, take if loss else 0)
                if take < n:
                    queue.append((doc, start + take, n - take, n - take if loss else 0))
            left -= room - b.room
            self.emit(b)


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    max_segments: int = 1024,
    max_loss: int = LENGTH,
    open_bins: int = 32,
    bears_loss: str | None = None,
) -> DataFrame:
    """Rows of docs (doc_id, text) as pieces of sequences: SCHEMA.

    bears_loss: a boolean column that tells whether a row's tokens bear loss (null: no); without one all do.
    In instruction data a row is a turn, and only the assistant's turns bear loss: see pack_turns. A sequence that a
    limit closes early keeps the rest of its length as padding. Sequences of one partition carry the partition's number in the upper bits of sequence_id. loss_tokens
    is the piece's share of the sequence's loss limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, out = _ids_of(tokenizer), []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
        tail = np.array([END], np.uint32)

        def emit(b: Bin) -> None:
            at = 0
            for (doc_id, ids), start, n, loss in b.pieces:
                crc = zlib.crc32(ids[start : start + n].tobytes())
                out.append((doc_id, start, n, crc, len(ids), b.number, at, loss))
                at += n

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                out.clear()

        packer = Packer(length, max_segments, max_loss, open_bins, TaskContext.get().partitionId() << 36, emit)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, loss, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), ids_of([t or b"" for t in part.column(1).to_pylist()])):
                    ids = np.concatenate([ids, tail]).astype("<u4")
                    packer.add((doc_id, ids), len(ids), (lambda _, n: n) if loss else lambda _, n: 0)
                yield from flush()
        packer.finish()
        yield from flush()

    loss = F.lit(True) if bears_loss is None else F.coalesce(F.col(bears_loss), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), loss.alias("loss")).mapInArrow(run, SCHEMA)


def pack_turns(conversations: DataFrame, tokenizer: str, max_segments: int = 64, max_loss: int = LENGTH // 2, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Turns (conv_id, turn, role, text) under three limits that differ: tokens, segments, and tokens of roles that bear loss."""
    turns = conversations.select(F.col("conv_id").alias("doc_id"), "text", F.col("role").isin(*roles).alias("loss"))
    return pack(turns, tokenizer, max_segments=max_segments, max_loss=max_loss, bears_loss="loss")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer()).drop("loss_tokens")


SQL = None
