"""Vector bin packing of tokenised examples into sequences, under limits on tokens, segments and loss tokens.

Every Spark task packs the rows of its own input split, so nothing is shuffled. It works in blocks of
bounded size. Whole sequences are cut off long examples first. The remainders are placed by the dot-product
heuristic: a bin takes, among the remainders that fit, the one whose weighted demand points most in the
direction of the room left. Gaps are then closed by cutting pieces of the emptiest bins; the bin left over
goes on into the next block, and the last one of a task is cut at powers of two, which need no padding.

Null text is empty: its only id is the closing separator. Repeated rows and null ids are packed like any
other row; extra columns are ignored; an empty table gives an empty result. A task that is run again packs
the same split in the same order, so sequence ids stay the same.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from boxlake.llm.common import slices

#: the tokenizer, and the same vocabulary as ranks
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SEPARATOR = b"\0\0\0\0"
#: ids are kept as little-endian unsigned 32-bit integers
WIDTH = 4


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


class Encoder(dict):
    """Token ids of a text as bytes, with a bounded cache of words (key: a word that follows a single space).

    The tokenizer's own pattern never joins a word to a single space after it, so a text may be cut before
    every such space; likewise letters are never joined to the punctuation after them. Pieces are encoded by
    ``tiktoken`` from the same vocabulary; only a text that spells a special token goes to the tokenizer whole.
    """

    def __init__(self, path: str, ranks: str, pattern: str, max_words: int = 250_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.max_words = max_words
        self.cut, self.odd_blank = re.compile(r"(?<=\S)(?= \S)"), re.compile(r"[^\S \n]")
        self.ending = re.compile(r"[^\W\d_]+([.,;:!?]+)")

    def piece(self, text: str) -> bytes:
        ids = array("I", self.ids(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        m = self.ending.fullmatch(word) if word and word[-1] in ".,;:!?" else None
        ids = self[word[:m.start(1)]] + self.piece(m[1]) if m else self.piece(" " + word)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > self.max_words:
            self.clear()
        first, *rest = text.split(" ")
        if "" in rest or not first or " \n" in text or "\n " in text or self.odd_blank.search(text):
            return b"".join([self[w[1:]] if w[:1] == " " and not w[1:2].isspace() else self.piece(w) for w in self.cut.split(text)])
        return self.piece(first) + b"".join(map(self.__getitem__, rest))


@cache
def encoder(path: str, ranks: str, pattern: str) -> Encoder:
    """One encoder per worker process; its cache serves all tasks that run there."""
    return Encoder(path, ranks, pattern)


@dataclass
class Example:
    doc_id: object
    ids: bytes
    bears_loss: bool
    total: int


@dataclass
class Piece:
    example: Example
    start: int
    length: int

    @property
    def loss(self) -> int:
        """All ids but the closing separator, where the example bears loss."""
        return (self.length - (self.start + self.length == self.example.total)) * self.example.bears_loss

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.example, self.start, n), Piece(self.example, self.start + n, self.length - n)


@dataclass
class Bin:
    pieces: list[Piece] = field(default_factory=list)
    tokens: int = 0
    loss: int = 0

    def add(self, p: Piece) -> None:
        self.pieces.append(p)
        self.tokens += p.length
        self.loss += p.loss

    def pop(self) -> Piece:
        p = self.pieces.pop()
        self.tokens -= p.length
        self.loss -= p.loss
        return p


def place(pieces: list[Piece], limits: Limits) -> list[Bin]:
    """Dot-product heuristic; ties go to the piece that came first. Pieces of equal demand are one kind."""
    kinds: dict[tuple[int, int], list[Piece]] = {}
    for p in reversed(pieces):
        kinds.setdefault((p.length, p.loss), []).append(p)
    keys = sorted(kinds, reverse=True)
    caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    need = np.array([[n, 1, loss] for n, loss in keys], float).reshape(-1, 3) / caps
    many = np.array([len(kinds[k]) for k in keys])
    weight = (need * many[:, None]).sum(axis=0) / max(1, many.sum())
    bins = []
    while len(need):
        room, bin_ = np.ones(3), Bin()
        while True:
            fits = (need <= room + 1e-9).all(axis=1) & (many > 0)
            if not fits.any():
                break
            best = int(np.where(fits, need @ (weight * room), -1).argmax())
            bin_.add(kinds[keys[best]].pop())
            many[best] -= 1
            room = room - need[best]
        bins.append(bin_)
        if not many.any():
            break
    return bins


def close_gaps(bins: list[Bin], limits: Limits) -> tuple[list[Bin], list[Piece]]:
    """Fill the fullest bins with pieces of the emptiest; returns closed bins and the pieces left over."""
    todo, done, left = sorted(bins, key=lambda b: -b.tokens), [], []
    while len(todo) > 1:
        into, giver = todo[0], todo[-1]
        room = min(limits.tokens - into.tokens, limits.loss_tokens - into.loss)
        if room <= 0 or len(into.pieces) >= limits.segments:
            done.append(todo.pop(0))
            continue
        p = giver.pop()
        if p.length > room:
            p, rest = p.split(room)
            giver.add(rest)
        into.add(p)
        if not giver.pieces:
            todo.pop()
    for b in todo:
        if b.tokens == limits.tokens or len(b.pieces) >= limits.segments:
            done.append(b)
        else:
            left = b.pieces
    return done, left


def at_powers(pieces: list[Piece]) -> list[Bin]:
    """Cut the last pieces of a task into sequences whose lengths are powers of two."""
    bins, rest = [], list(reversed(pieces))
    while rest:
        size, b = 1 << (sum(p.length for p in rest).bit_length() - 1), Bin()
        while b.tokens < size:
            p = rest.pop()
            if p.length > size - b.tokens:
                p, more = p.split(size - b.tokens)
                rest.append(more)
            b.add(p)
        bins.append(b)
    return bins


def pack_split(rows: Iterator[tuple[object, bytes, bool]], limits: Limits, max_tokens: int = 2_000_000,
               max_pieces: int = 2048) -> Iterator[Bin]:
    """Sequences of one task. ``rows``: (id, ids as bytes, whether they bear loss)."""
    pieces, held = [], 0
    whole = min(limits.tokens, limits.loss_tokens)
    for doc_id, ids, bears_loss in rows:
        e = Example(doc_id, ids, bears_loss, len(ids) // WIDTH)
        full = e.total // whole * whole
        for at in range(0, full, whole):
            b = Bin()
            b.add(Piece(e, at, whole))
            yield b
        if e.total > full:
            pieces.append(Piece(e, full, e.total - full))
            held += e.total
        if held > max_tokens or len(pieces) >= max_pieces:
            done, pieces = close_gaps(place(pieces, limits), limits)
            yield from done
            held = sum(p.example.total for p in pieces)
    done, pieces = close_gaps(place(pieces, limits), limits)
    yield from done
    yield from at_powers(pieces)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", loss: Column | None = None,
         limits: Limits = Limits(), tokenizer: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``loss``: boolean column, whether a row's tokens bear loss (all by default). ``tokenizer``: paths of a
    tokenizer file and of its ranks, which every executor can read, and the pattern of its words."""
    schema = StructType([StructField(doc_id, docs.schema[doc_id].dataType)] + [StructField(c, LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    if with_ids:
        schema = schema.add("ids", ArrayType(LongType()))
    names, types = schema.names, to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(*tokenizer or (public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)).encode
        base = TaskContext.get().partitionId() << 33

        def rows():
            for b in slices(batches, "t", 1 << 20):
                for i, t, y in zip(*(b.column(c).to_pylist() for c in "itl"), strict=True):
                    yield i, encode(t or "") + SEPARATOR, bool(y)

        def table(found: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

        found = []
        for n, b in enumerate(pack_split(rows(), limits)):
            at = 0
            for p in b.pieces:
                ids = memoryview(p.example.ids)[WIDTH * p.start:WIDTH * (p.start + p.length)]
                found.append([p.example.doc_id, p.start, p.length, zlib.crc32(ids), p.example.total, base + n, at]
                             + [np.frombuffer(ids, "<u4").tolist()] * with_ids)
                at += p.length
            if len(found) >= (1000 if with_ids else 20_000):
                yield table(found)
                found = []
        if found:
            yield table(found)

    bears = F.lit(True) if loss is None else loss
    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), bears.alias("l")).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs)
