"""Spelling variants: words one edit apart, grouped under their common forms.

Words are runs of letters, lower-cased in A-Z only, counted over all documents. Two words are near if one inserted,
deleted or replaced code point makes one of the other. Such an edit changes a word's counts of letters by one in one
place (adjacent lengths) or in two (equal lengths), so the squared distance of the count vectors is one or two.

Pairs are found by Gram matrices: words of one block times words of another give all squared distances of the two in
one matrix product; the few pairs at one (adjacent lengths) or two (equal lengths) are verified letter by letter. A
block holds words of one length and, as lengths alone make large blocks, of one number of letters in each class of
``CLASSES``: an edit takes a letter from one class and gives one to another, so each block meets its own kind and a
fixed number of neighbours (``_moves``). Blocks over ``SIZE`` words are cut, and each cut meets each; a word is sent to
the pieces of its block and to no pair list.

A word's form is its near word of largest count, ties by code points, if that has ``TIMES`` its count. Counts grow along
forms by that factor, so the way to the root is short; it is followed by doubling steps.

Defined results: null texts hold no word. Words are counted in every row, repeated rows included; a null id takes part
in the hash as the text ``None``. One very long text costs its own words, one very long run is one word. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import slices
from boxlake.session import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: an occurrence loses a letter where this divides the hash of its document and run
TYPO = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: letters fall into classes that are about equally frequent; all others are the last class
CLASSES = ("ae", "io", "rtu", "nsl")
#: words in a piece of a block; a product is at most SIZE by SIZE
SIZE = 2048
#: distinct words that a task counts before it sends them on
HELD = 200_000
#: letters of words: a to z, then the code points from C0 to FF
LETTERS = 26 + 64


def occurrence(doc_id, run: str, typo: int = TYPO) -> str:
    """The run as it is counted in a document: lower-cased, now and then without one letter."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % typo:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def lower(text: str) -> str:
    """Lower case for A to Z only."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, typo: int = TYPO) -> DataFrame:
    """(word, n) over all documents; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for b in slices(batches, "t"):
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                head = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(RUN.findall(lower(t))).items() if t else ():
                    # the hash of document and run is the hash of the document continued
                    if zlib.crc32(w.encode(), head) % typo == 0:
                        w = occurrence(i, w, typo)
                    if len(w) >= least:
                        held[w] += n
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[str]) -> np.ndarray:
    """[word, letter] counts, exact in the type that also holds their squares."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    column = np.where(codes >= 0xC0, codes - 0xC0 + 26, codes - ord("a"))
    sizes = [len(w) for w in words]
    at = np.repeat(np.arange(len(words)), sizes) * LETTERS + column
    kind = np.float32 if max(sizes, default=0) < 2000 else np.float64
    return np.bincount(at, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(kind)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def near_in_blocks(left: list[str], right: list[str], same: bool) -> list[tuple[int, int]]:
    """Pairs (i, j) one edit apart of words of two blocks, each of one length; ``same``: one block, pairs once."""
    x, y = letter_counts(left), letter_counts(right)
    wanted = 2 if len(left[0]) == len(right[0]) else 1
    if x.dtype != y.dtype:
        x, y = x.astype(np.float64), y.astype(np.float64)
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    i, j = np.nonzero(squared == wanted)
    if same:
        i, j = i[i < j], j[i < j]
    return [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if one_edit(left[a], right[b])]


def _moves() -> list[tuple[int, ...]]:
    """Changes of the numbers of letters by class that one edit can make, each pair of opposites once: none, one
    letter more, or one letter from one class to another."""
    k = len(CLASSES) + 1
    unit = np.eye(k, dtype=int)
    return [tuple([0] * k), *map(tuple, unit.tolist()), *[tuple((unit[b] - unit[a]).tolist()) for a in range(k) for b in range(a + 1, k)]]


def _block(word: Column) -> list[Column]:
    """Number of letters by class, the last class first."""
    size = F.length(word)
    counts = [size - F.length(F.translate(word, letters, "")) for letters in CLASSES]
    rest = size
    for c in counts:
        rest = rest - c
    return [rest, *counts]


def near_pairs(words: DataFrame, size: int = SIZE) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of near words, each once. ``words``: (word, n), words distinct."""
    k = len(CLASSES) + 1
    keyed = words.select("word", "n", *[c.alias(f"c{i}") for i, c in enumerate(_block(F.col("word")))])
    keyed = keyed.withColumn("cell", F.concat_ws(",", *[f"c{i}" for i in range(k)]))
    pieces = keyed.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("pieces"))
    own = cut(keyed.join(pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")))
    # cells that a move leads to; a word goes to the pieces of its own and of those cells alone
    moves = F.explode(F.array(*[F.struct(F.lit(m).alias("move"), F.concat_ws(",", *[(F.col(f"c{i}") + d).cast("string") for i, d in enumerate(delta)])
                                         .alias("to")) for m, delta in enumerate(_moves())]))
    cells = own.groupBy("cell", *[f"c{i}" for i in range(k)]).agg(F.first("pieces").alias("pieces"))
    meets = (cells.select("cell", "pieces", moves.alias("m")).select("cell", "pieces", "m.move", "m.to")
             .join(pieces.select(F.col("cell").alias("to"), F.col("pieces").alias("to_pieces")), "to"))
    meets = cut(meets.select("cell", "to", "move", "pieces", "to_pieces"))
    job = [F.col("cell").alias("from_cell"), "to", "move"]
    lefts = (own.select("cell", "piece", "word", "n").join(meets.drop("pieces"), "cell")
             .withColumn("to_piece", F.explode(F.sequence(F.lit(0), F.col("to_pieces") - 1)))
             .where((F.col("move") > 0) | (F.col("piece") <= F.col("to_piece")))
             .select(*job, "piece", "to_piece", F.lit(0).alias("side"), "word", "n"))
    rights = (own.select(F.col("cell").alias("to"), F.col("piece").alias("to_piece"), "word", "n")
              .join(meets.select("cell", "to", "move", "pieces").where("move > 0 or pieces > 1"), "to")
              .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
              .where((F.col("move") > 0) | (F.col("piece") < F.col("to_piece")))
              .select(*job, "piece", "to_piece", F.lit(1).alias("side"), "word", "n"))
    keys = ["from_cell", "to", "piece", "to_piece"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole pairs of pieces in order, each at most two pieces of words."""
        def solve(rows: pd.DataFrame) -> list[tuple]:
            a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
            same = not len(b)
            if same:
                b = a
            u, v, m, n = a["word"].tolist(), b["word"].tolist(), a["n"].tolist(), b["n"].tolist()
            return [(u[i], m[i], v[j], n[j]) for i, j in near_in_blocks(u, v, same)] if u and v else []

        def batch(found: list[tuple]) -> pa.RecordBatch:
            u, m, v, n = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(m, pa.int64()), pa.array(v, pa.string()), pa.array(n, pa.int64())],
                                              ["a", "n_a", "b", "n_b"])

        rest, found = None, []
        for b in batches:
            rows = b.to_pandas()
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            new = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            for lo, hi in zip(new, new[1:], strict=False):
                found += solve(rows.iloc[lo:hi])
            rest = rows.iloc[new[-1]:] if new else None
            if found:
                yield batch(found)
                found = []
        if rest is not None and (found := solve(rest)):
            yield batch(found)

    return (lefts.unionByName(rights).repartition(*keys).sortWithinPartitions(*keys, "side")
            .mapInArrow(products, "a string, n_a long, b string, n_b long"))


def forms(words: DataFrame, size: int = SIZE, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    pairs = cut(near_pairs(words, size))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    # the largest count, then the smallest word
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.near")).alias("form"), (-F.col("best.less")).alias("best_n")))
    step = cut(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the way; counts grow by ``times`` on each step of it
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return found.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    return forms(cut(count_words(docs).where(F.col("n") >= LEAST_COUNT)), size)
