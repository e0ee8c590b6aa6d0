"""Benchmark decontamination: documents that hold a benchmark item, up to edits.

Items and documents are sequences of words (runs of word characters, lower-cased) joined by single spaces. A
document holds an item when the edit distance between the item and the nearest stretch of the document is at
most (1 - ``similarity``) of the item's characters; that check is exact and looks at candidates only.

Candidates come from random walks over characters. A walk puts out the character it stands on and moves on or
stays, as a random function of that character and the step's number says; two texts that differ by few edits so
become strings that agree at most places. A key is a sample of the places of one walk. Walks of an item begin
at each of its characters and in each of the ``REPEATS`` repetitions, which have their own functions and samples;
each character of a document begins one walk, its repetition going round. Equal keys tell where the item would lie;
where ``HITS`` of them tell nearly the same place, the window of the item's size there is checked. How many steps the
walks of an item take is measured, not assumed: ``walk_length`` edits random texts of the item's length up to the limit
and takes the longest walks at which the share with ``HITS`` equal keys reaches ``recall``. An unedited copy is always
found. Walks whose first steps agree with no item end there, which loses none.

Items are taken in blocks of ``BLOCK``, so that an index fits a task for any benchmark; the driver holds the texts
of one block, tasks build the index, and every block is one pass over the documents, which are never shuffled.

Defined results: null and empty texts hold nothing. An item of fewer than ``MIN_WORDS`` words is held only as
it is, word for word: with edits it is too short to tell from chance. Items of one word or none are skipped.
Rows never meet, so repeated documents are each reported and null ids pass through; of items with equal ids the
nearest counts. A very long text is a slice of its own and takes about 100 bytes of memory per character. Extra
columns of any name pass through ``remove_leaks``; empty tables give no leaks.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from boxlake.llm.common import slices

WORD = re.compile(r"\w+")
BLOCK = 2000
MIN_WORDS = 5
#: walks per item beginning; longest walk; share of a walk's places that its key samples
REPEATS, STEPS, SAMPLE = 4, 40, 0.7
#: after so many steps, walks that agree with no item end
GATES = (10, 16)
#: equal keys that a window of an item with edits needs, and into how many strips an item's length is cut to count them
HITS, STRIPS = 6, 24
#: windows that are checked together; walks that go together, few enough for the processor's cache
WINDOWS, WALKS = 1024, 1 << 14
#: items of more words of 64 bits are checked window by window
LONG_WORDS = 16
#: random texts per length when walks are measured, their letters, and the length beyond which items count as no longer
TRIALS, LETTERS, LONG = 120, 20, 600


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """(a random word per repetition, step and character class, whose lowest bit says whether the walk moves on;
    whether the place is in the key's sample). The first place always is."""
    rng = np.random.default_rng(2024)
    words = rng.integers(-(1 << 63), (1 << 63) - 1, (REPEATS, STEPS, 256))
    sampled = rng.random((REPEATS, STEPS)) < SAMPLE
    sampled[:, 0] = True
    return words, sampled


def classes(codes: np.ndarray) -> np.ndarray:
    """Code points as numbers below 256 for the walks; the end of a text counts as a space. Equal classes of different
    characters only make more candidates."""
    folded = np.where(codes < 128, codes, 128 + ((codes * np.uint32(2654435761)) >> np.uint32(25)))
    return np.where(codes == 0, 32, folded).astype(np.int64)


def walk(letters: np.ndarray, at: np.ndarray, repeat: int, steps: int, first: int = 0,
         keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of walks after steps ``first`` to ``steps``; ``letters`` goes on for ``STEPS`` behind the last."""
    words, sampled = _functions()
    at = at.copy()
    keys = np.zeros(len(at), np.int64) if keys is None else keys.copy()
    for j in range(first, steps):
        word = words[repeat, j].take(letters.take(at))
        if sampled[repeat, j]:
            keys ^= word
        word &= 1
        at += word
    return at, keys


def equal_keys(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``keys``, places in the sorted ``own``) of all equal pairs."""
    left, right = (np.searchsorted(own, keys, side=x) for x in ("left", "right"))
    many = right - left
    k = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.arange(len(keys)), many), k


def strip(chars):
    """Width of the strips of beginnings in which equal keys are counted, for an item of so many characters."""
    return chars // STRIPS + 1


def crowded(group: np.ndarray, at: np.ndarray, need) -> tuple[np.ndarray, np.ndarray]:
    """(group, strip) where a strip and the next hold ``need`` (of the group) or more of the rows; strips from -``STRIPS``."""
    rows, count = np.unique((group << 32) + at + 2 * STRIPS, return_counts=True)
    pair = np.flatnonzero(rows[1:] == rows[:-1] + 1)
    both = count.copy()
    both[pair] += count[pair + 1]
    # a copy whose equal keys lie in one strip is found as well without the strip before
    group = rows >> 32
    much = both >= need(group)
    return group[much], (rows[much] & 0xFFFFFFFF) - 2 * STRIPS


def _edited(text: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """``text`` with ``edits`` letters at random places changed, gone, or with one added before them."""
    kind = np.zeros(len(text), np.int64)
    kind[rng.choice(len(text), edits, replace=False)] = rng.integers(1, 4, edits)
    source = np.repeat(np.arange(len(text)), np.array([1, 1, 0, 2])[kind])
    fresh = (kind[source] == 1) | ((kind[source] == 3) & np.append(True, source[1:] != source[:-1])[:len(source)])
    return np.where(fresh, (text[source] + rng.integers(1, LETTERS, len(source))) % LETTERS, text[source])


@cache
def _measured(chars: int, edits: int, recall: float) -> int:
    rng = np.random.default_rng(chars)
    items = [rng.integers(0, LETTERS, chars) for _ in range(TRIALS)]
    copies = [_edited(t, edits, rng) for t in items]
    sides = []
    for texts, end in ((items, LETTERS), (copies, LETTERS + 1)):
        size = np.array([len(t) for t in texts])
        letters = np.concatenate([np.append(t, np.full(STEPS + 1, end)) for t in texts]).astype(np.int64)
        begin = np.cumsum(size + STEPS + 1) - (size + STEPS + 1)
        trial = np.repeat(np.arange(TRIALS), size)
        inside = np.arange(len(trial)) - np.repeat(np.cumsum(size) - size, size)
        sides.append((letters, begin[trial] + inside, trial, inside, begin[trial] + size[trial]))

    def found(steps: int) -> float:
        (letters, at, trial, offset, end), (others, there, other, inside, _) = sides
        groups, places = [], []
        for r in range(REPEATS):
            last, keys = walk(letters, at, r, steps)
            fits = np.flatnonzero(last <= end)
            fits = fits[np.argsort(keys[fits] + trial[fits], kind="stable")]
            turn = np.flatnonzero((inside + other) % REPEATS == r)  # a copy may lie anywhere in a document
            _, seen = walk(others, there[turn], r, steps)
            a, b = equal_keys((keys + trial)[fits], seen + other[turn])
            a, b = turn[a], fits[b]
            groups.append(other[a])
            places.append((inside[a] - offset[b] + 7 * other[a]) // strip(chars))  # nor does it begin with a strip
        found, _ = crowded(np.concatenate(groups), np.concatenate(places), lambda g: HITS)
        return len(np.unique(found)) / TRIALS

    low, high = 1, max(1, min(chars - HITS + 1, STEPS) // 2)  # in pairs of steps
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if found(2 * middle) >= recall else (low, middle - 1)
    return 2 * low


def walk_length(chars: int, edits: int, recall: float) -> int:
    """Most steps (even, ``STEPS`` at most) at which walks find ``recall`` of the texts of ``chars`` characters with
    ``edits`` of them, at random places, edited; measured on the next shorter length of a grid of a fifth. Without
    edits, as many as an unedited copy agrees in for certain."""
    if not edits:
        return max(1, min(chars - HITS + 1, STEPS))
    grid = min(chars, LONG)
    if grid > 20:
        grid = int(20 * 1.2 ** int(math.log(grid / 20 + 1e-9, 1.2)))
    return _measured(grid, min(grid, math.ceil(edits * grid / chars)), recall)


@dataclass
class Layer:
    """Keys of the items whose walks take equally many steps, in one repetition."""

    keys: np.ndarray  # sorted
    items: np.ndarray  # item of each key
    offsets: np.ndarray  # where its walk begins in the item
    table: np.ndarray  # quick test of a key


@dataclass
class Item:
    id: object
    text: str  # words joined by single spaces
    edits: int  # at most; 0 of items that count only as they are
    whole: bool
    steps: int


@dataclass
class Index:
    items: list[Item]
    length: np.ndarray
    edits: np.ndarray
    need: np.ndarray  # equal keys
    letters: np.ndarray  # item and code point, sorted: the letters of each item
    masks: np.ndarray  # [letter, word of 64 bits]: where it stands in the item; the last row is of no letter
    layers: list[dict[int, Layer]]  # per repetition, by steps
    gates: list[dict[int, np.ndarray]]  # per repetition, by steps: quick test of the items that walk on


@cache
def _word_characters() -> np.ndarray:
    """Which code points ``WORD`` takes."""
    return np.frombuffer(bytes(c.isalnum() or c == "_" for c in map(chr, range(sys.maxunicode + 1))), bool)


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins): words of a text joined by single spaces, with a 0 behind it."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low]) - 1
    word = _word_characters()[codes]
    keep = word.copy()
    keep[1:] |= word[:-1]  # of what is between two words the first character stays
    keep[ends] = True
    out = np.where(word, codes, np.uint32(32))
    out[ends] = 0
    out = out[keep]
    out = out[~np.append((out[:-1] == 32) & (out[1:] == 0), False)]
    return out, np.append(0, np.flatnonzero(out == 0)[:-1] + 1)


def _table(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << max(16, (8 * len(keys)).bit_length()), bool)
    table[_slots(keys, table)] = True
    return table


def _slots(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(65 - len(table).bit_length())).view(np.int64)


def prepare(items: list[tuple], recall: float, similarity: float) -> list[Item]:
    """What the index needs of each (id, text) pair; items of one word or none are left out."""
    out = []
    for key, t in items:
        words = WORD.findall((t or "").lower())
        if len(words) > 1:
            text, whole = " ".join(words), len(words) < MIN_WORDS
            edits = 0 if whole else int((1 - similarity) * len(text) + 1e-9)
            # above the target, since the measure is a sample
            steps = min(len(text), STEPS) if whole else walk_length(len(text), edits, (1 + 3 * recall) / 4)
            out.append(Item(key, text, edits, whole, steps))
    return out


def index_of(items: list[Item]) -> Index:
    length = np.array([len(x.text) for x in items], np.int64)
    steps = np.array([x.steps for x in items], np.int64)
    layers, gates = [{} for _ in range(REPEATS)], [{} for _ in range(REPEATS)]
    if items:
        letters = classes(np.array([ord(c) for x in items for c in x.text + "\0" * (STEPS + 1)], np.uint32))
        begin = np.cumsum(length + STEPS + 1) - (length + STEPS + 1)
        item = np.repeat(np.arange(len(items)), length)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(length) - length, length)
    for r in range(REPEATS if items else 0):
        for size in np.unique(steps).tolist():
            own = steps[item] == size
            k, o = item[own], offset[own]
            last, keys = walk(letters, begin[k] + o, r, size)
            inside = last <= begin[k] + length[k]
            k, o, keys = k[inside], o[inside], keys[inside]
            order = np.argsort(keys, kind="stable")
            layers[r][size] = Layer(keys[order], k[order], o[order], _table(keys))
        for gate in GATES:
            own = steps[item] > gate
            if own.any():
                gates[r][gate] = _table(walk(letters, (begin[item] + offset)[own], r, gate)[1])
    own = np.repeat(np.arange(len(items)), length)
    codes = np.array([ord(c) for x in items for c in x.text], np.int64)
    at = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
    short = (length <= 64 * LONG_WORDS)[own]
    known, row = np.unique(((own << 21) + codes)[short], return_inverse=True)
    at = at[short]
    masks = np.zeros((len(known) + 1, int(at.max(initial=0)) // 64 + 1), np.uint64)
    np.bitwise_or.at(masks, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return Index(items, length, np.array([x.edits for x in items], np.int64),
                 np.array([1 if x.whole else HITS for x in items], np.int64), known, masks, layers, gates)


def build_index(items: list[tuple], recall: float = 0.95, similarity: float = 0.8) -> Index:
    """Index of (id, text) pairs."""
    return index_of(prepare(items, recall, similarity))


@lru_cache(maxsize=2)
def shared_index(rows: tuple) -> Index:
    """The index of a block of prepared items; a Python worker serves many tasks, which share it."""
    return index_of([Item(*x) for x in rows])


def nearest(pattern: str, text: str) -> int:
    """Edit distance between the pattern and the nearest substring of the text; one integer per column of the table."""
    mask, high = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    places: dict[str, list[int]] = {}
    for i, c in enumerate(pattern):
        places.setdefault(c, []).append(i)
    eq = {}
    for c, at in places.items():
        bits = bytearray(len(pattern) // 8 + 1)
        for i in at:
            bits[i // 8] |= 1 << i % 8
        eq[c] = int.from_bytes(bits, "little")
    plus, minus, score = mask, 0, len(pattern)
    best = score
    for c in text:
        e = eq.get(c, 0)
        xv = e | minus
        xh = (((e & plus) + plus) ^ plus) | e
        ph, mh = (minus | ~(xh | plus)) & mask, plus & xh
        score += bool(ph & high) - bool(mh & high)
        best = min(best, score)
        ph, mh = ph << 1, mh << 1
        plus, minus = (mh | ~(xv | ph)) & mask, ph & xv
    return best


def distances(codes: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, index: Index) -> np.ndarray:
    """Edit distance between each item and the nearest stretch of ``codes[lo:hi]``: the bit-parallel form of the usual
    table, one column of many windows at a time, ``words`` words of 64 bits each."""
    out = np.zeros(len(item), np.int64)
    size = (index.length[item] + 63) // 64
    for words in np.unique(size).tolist():
        group = np.flatnonzero(size == words)
        group = group[np.argsort(hi[group] - lo[group], kind="stable")]
        if words > LONG_WORDS:  # one window keeps the processor busy by itself
            for k in group.tolist():
                out[k] = nearest(index.items[item[k]].text, codes[lo[k]:hi[k]].tobytes().decode("utf-32-le", "surrogatepass"))
            continue
        for start in range(0, len(group), WINDOWS):
            some = group[start:start + WINDOWS]
            out[some] = _columns(codes, item[some], lo[some], hi[some], words, index)
    return out


def _columns(codes: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: int, index: Index) -> np.ndarray:
    one, top = np.uint64(1), np.uint64(63)
    at = lo + np.arange(int((hi - lo).max(initial=0)))[:, None]
    letter = (item << 21) + np.where(at < hi, codes.take(at, mode="clip"), 0).astype(np.int64)  # no item holds code 0
    row = np.minimum(np.searchsorted(index.letters, letter), len(index.letters) - 1)
    row[index.letters[row] != letter] = len(index.letters)
    shift = ((index.length[item] - 1) % 64).astype(np.uint64)
    plus, minus = np.full((words, len(item)), ~np.uint64(0)), np.zeros((words, len(item)), np.uint64)
    score = index.length[item].copy()
    best = score.copy()
    for rows in row:
        carry = up = down = np.zeros(len(item), np.uint64)
        for w in range(words):
            eq, pv, mv = index.masks[rows, w], plus[w], minus[w]
            xv = eq | mv
            first = (eq & pv) + pv
            total = first + carry
            carry = ((first < pv) | (total < first)).astype(np.uint64)
            xh = (total ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if w == words - 1:
                score += ((ph >> shift) & one).astype(np.int64) - ((mh >> shift) & one).astype(np.int64)
            ph, up = (ph << one) | up, ph >> top
            mh, down = (mh << one) | down, mh >> top
            plus[w], minus[w] = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best


def _meetings(letters: np.ndarray, at: np.ndarray, layers: dict[int, Layer], gates: dict[int, np.ndarray],
              repeat: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(beginnings, items, beginnings in the items) of walks with equal keys."""
    begin, keys, done = at, None, 0
    for steps in sorted({*layers, *gates}):
        at, keys = walk(letters, at, repeat, steps, done, keys)
        done = steps
        if layer := layers.get(steps):
            near = np.flatnonzero(layer.table.take(_slots(keys, layer.table)))
            a, b = equal_keys(layer.keys, keys[near])
            yield begin[near[a]], layer.items[b], layer.offsets[b]
        if steps in gates:
            stay = np.flatnonzero(gates[steps].take(_slots(keys, gates[steps])))
            begin, at, keys = begin[stay], at[stay], keys[stay]


def candidates(codes: np.ndarray, starts: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, items, first characters and ends of the windows that may hold an item, in order of the first two.
    An item that stands in a document in full lies inside one of them with all its edits."""
    ends = np.append(starts[1:], len(codes)) - 1
    letters = np.append(classes(codes), np.full(STEPS + 1, 32))
    width, total = strip(index.length), len(index.items)
    place = np.arange(len(codes))
    turn = ((place - np.repeat(starts, ends - starts + 1)) % REPEATS).astype(np.int8)
    groups, strips = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in range(REPEATS):
        own = np.flatnonzero(turn == r)
        for piece in range(0, len(own), WALKS):
            for at, item, offset in _meetings(letters, own[piece:piece + WALKS], index.layers[r], index.gates[r], r):
                doc = np.searchsorted(starts, at, side="right") - 1
                groups.append(doc * total + item)
                strips.append((at - offset - starts[doc]) // width[item])
    group, near = crowded(np.concatenate(groups), np.concatenate(strips), lambda g: index.need[g % total])
    doc, item = np.divmod(group, total)
    lo = np.maximum(starts[doc], starts[doc] + near * width[item] - index.edits[item])
    hi = np.minimum(ends[doc], starts[doc] + (near + 2) * width[item] + index.length[item] + index.edits[item])
    return doc, item, lo, hi


def _stands(plain: str, text: str, lo: int, hi: int) -> bool:
    """Whether the words of ``text`` stand in ``plain[lo:hi]``; texts end with a 0."""
    at = plain.find(text, lo, hi)
    while at >= 0:
        if (not at or plain[at - 1] in " \0") and plain[at + len(text)] in " \0":
            return True
        at = plain.find(text, at + 1, hi)
    return False


def leaks(texts: list[str], index: Index, similarity: float) -> list[list[tuple]]:
    """Per text: (item id, distance, similarity, first word, words looked at) of each item it holds."""
    best: list[dict] = [{} for _ in texts]
    if not texts or not index.items:
        return [[] for _ in texts]
    codes, starts = normal(texts)
    plain = codes.tobytes().decode("utf-32-le", "surrogatepass")
    doc, item, lo, hi = candidates(codes, starts, index)
    near = distances(codes, item, lo, hi, index)
    some = np.flatnonzero(near <= index.edits[item])
    for d, n, a, b, distance in zip(*(x[some].tolist() for x in (doc, item, lo, hi, near)), strict=True):
        text, at = index.items[n].text, a
        if index.items[n].whole and not _stands(plain, text, a, b):
            continue
        share = 1 - distance / len(text)
        key = index.items[n].id
        if share >= similarity and (key not in best[d] or (distance, at) < (best[d][key][0], best[d][key][2])):
            best[d][key] = (distance, share, at, b)
    return [[(k, n, share, plain.count(" ", int(start), lo), plain.count(" ", lo, hi) + 1) for k, (n, share, lo, hi) in b.items()]
            for b, start in zip(best, starts, strict=True)]


def _leak_type(item_type) -> ArrayType:
    return ArrayType(StructType([StructField("item_id", item_type), StructField("distance", LongType()),
                                 StructField("similarity", DoubleType()), StructField("first_word", LongType()),
                                 StructField("n_words", LongType())]))


def _blocks(benchmark: DataFrame, item_id: str, text: str, recall: float, similarity: float) -> Iterator[tuple]:
    """Prepared items in blocks of ``BLOCK``; the driver holds one block at a time."""
    rows = ((r[0], r[1]) for r in benchmark.select(item_id, text).toLocalIterator())
    while block := list(islice(rows, BLOCK)):
        yield tuple((x.id, x.text, x.edits, x.whole, x.steps) for x in prepare(block, recall, similarity))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """One row per document row and item that it holds: ids, distance, similarity, and the words looked at."""
    kind = _leak_type(benchmark.schema[item_id].dataType)
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema, names, arrow = StructType([chosen.schema["id"], StructField("leaks", kind)]), kind.elementType.names, to_arrow_type(kind)

    def one(items: tuple) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared_index(items)
            for b in slices(batches, "text", 1 << 21):
                found = leaks([t or "" for t in b.column("text").to_pylist()], index, similarity)
                rows = pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in found], arrow)
                yield pa.RecordBatch.from_arrays([b.column("id"), rows], ["id", "leaks"])

        rows = chosen.mapInArrow(run, schema).select(F.col("id").alias(doc_id), F.explode("leaks").alias("leak"))
        return rows.select(F.col(doc_id), "leak.*")

    found = None
    for items in _blocks(benchmark, item_id, item_text, recall, similarity):
        found = one(items) if found is None else found.unionByName(one(items))
    return one(()) if found is None else found


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""

    def without(docs: DataFrame, items: tuple) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared_index(items)
            for b in slices(batches, text, 1 << 21):
                found = leaks([t or "" for t in b.column(text).to_pylist()], index, similarity)
                yield b.filter(pa.array([not x for x in found], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    for items in _blocks(benchmark, item_id, item_text, recall, similarity):
        docs = without(docs, items)
    return docs


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark)
