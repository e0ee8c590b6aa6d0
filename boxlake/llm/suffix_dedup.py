"""Suffix-array dedup: remove passages that also stand in a document with a smaller id.

A byte goes when it lies in a ``SPAN``-byte string that also starts in a document with a smaller id, judged on
the input. Suffixes of a whole corpus cannot be sorted in one place, so strings that may be equal are brought
together first:

1. Every window of ``SPAN`` bytes is named by the smallest hash of the ``GRAM``-byte strings inside it; equal
   windows have equal names. Neighbouring windows with one name form a segment. Each group of documents sends
   its names (short hashes, with the order of magnitude of its distinct segments) to buckets, and a bucket answers
   which names occur in several documents and which are hot: of more than ``HOT`` distinct segments a group. What
   many documents hold alike is no load, since a group sends it once.
2. A segment at the edge of a shared passage also holds bytes of its document's own, so a hot name would bring one
   bucket a segment from every document. Segments of hot names are cut into single windows; the groups send the
   hashes of these windows to buckets, which answer those that several documents hold. All others can match nothing.
3. Segments of other shared names go to their bucket, and windows of hot names that several documents hold to the
   bucket of their hash, equal ones of a group once. Each bucket sorts the suffixes of
   its segments in two stages, computes adjacent common prefixes and reads from runs of at least ``SPAN``
   bytes the smallest document of every window.
4. The groups mark and cut the bytes of windows whose smallest document is smaller than their own.

Groups and buckets are both as many as the square root of the expected names allows (and no smaller than a slice), so the rows between them
and the size of each grow as the square root of the input. What many documents have in common is one entry per group
and window. All visits to the texts use one shuffle of them.

Null text is empty. Rows with one id are one document: they never match each other. A null id sorts last, is
returned as null, and such rows count as one document. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from boxlake.llm.common import NO_ID
from boxlake.llm.near_dup import mix
from boxlake.llm.suffix_array import common_prefixes, join, two_stage

SPAN, GRAM = 50, 16
#: bits of a name that travel beside its bucket; the three lowest of six bytes say how many segments it has in its
#: group (``LOADS``) and whether it is in several documents
SHORT = 45
_MASK = np.uint64((1 << SHORT) - 1)
_SLICE = 4 << 20
#: steps of the number of distinct segments, and what a name of each step counts for
STEPS, LOADS = np.array([4, 32, 256]), np.array([2, 12, 96, 1024])
#: a name is hot if it counts for more than this per group
HOT = 16


def _windows(text: np.ndarray, span: int) -> np.ndarray:
    """Name of the window at every place: smallest hash of its ``GRAM``-byte strings."""
    n = len(text) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.ndarray(len(text) - 7, "<u8", text.data, strides=(1,))
    h = mix(words[:len(text) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[8:8 + len(text) - GRAM + 1].astype(np.uint64)))
    width, have = span - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:len(h) - step], h[step:])
        have += step
    return h[:n]


class Group:
    """Texts of one group in order of (id, text), and their segments slice by slice."""

    def __init__(self, table: pa.Table, span: int):
        ids = table.column("id").to_pylist()
        texts = [t or b"" for t in table.column("t").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids, self.texts, self.span = np.array([ids[k] for k in order], np.int64), [texts[k] for k in order], span
        self.order = pa.array(order, pa.int64())

    def slices(self) -> Iterator[tuple[int, list[bytes]]]:
        first, held = 0, 0
        for k, t in enumerate(self.texts):
            if held and held + len(t) > _SLICE:
                yield first, self.texts[first:k]
                first, held = k, 0
            held += len(t)
        if first < len(self.texts):
            yield first, self.texts[first:]

    def segments(self) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice: (bytes, first document, names, start, windows, document) of its segments in order of place."""
        for first, texts in self.slices():
            data = b"".join(texts)
            sizes = np.array([len(t) for t in texts])
            names = _windows(np.frombuffer(data, np.uint8), self.span)
            doc = np.repeat(np.arange(len(texts)), sizes)[:len(names)]
            inside = np.arange(len(names)) + self.span <= np.cumsum(sizes)[doc]
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
            starts = np.flatnonzero(new)
            count = np.diff(np.append(starts, len(names)))
            keep = inside[starts]
            starts, count = starts[keep], count[keep]
            # smallest hashes crowd at the low end; mixed once more they spread evenly over the buckets
            yield data, first, mix(names[starts]), starts, count, doc[starts]


def _place(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, short name); names in order have buckets in order."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), names & _MASK


def _window_names(data: bytes, at: np.ndarray, span: int) -> np.ndarray:
    """Hash of all bytes of the windows at some places."""
    text = np.frombuffer(data, np.uint8)
    words = np.ndarray(max(0, len(text) - 7), "<u8", text.data, strides=(1,))
    h = np.zeros(len(at), np.uint64)
    for w in (*range(0, span - 7, 8), span - 8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ words[at + w])
    return h


def _six(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers byte place by byte place: the high places are alike, so a shuffle compresses them."""
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _by_bucket(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], g: int, buckets: int) -> pa.Table:
    """Distinct names of a group by bucket, from (names, ids, contents); the lowest bit says "in several documents",
    the two above it give the step of the number of distinct contents."""
    names, contents = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.uint64) for k in (0, 2))
    ids = np.concatenate([x[1] for x in found]) if found else np.empty(0, np.int64)
    order = np.lexsort((contents, names))
    names, ids, contents = names[order], ids[order], contents[order]
    fresh = np.concatenate([[True], names[1:] != names[:-1]]) if len(names) else np.empty(0, bool)
    new = np.flatnonzero(fresh)
    several, step = np.empty(0, bool), np.empty(0, np.int64)
    if len(new):
        several = np.minimum.reduceat(ids, new) != np.maximum.reduceat(ids, new)
        other = fresh | np.concatenate([[True], contents[1:] != contents[:-1]])
        step = np.searchsorted(STEPS, np.add.reduceat(other.astype(np.int64), new))
    bucket, short = _place(names[new], buckets)
    value = short << np.uint64(3) | step.astype(np.uint64) << np.uint64(1) | several.astype(np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    blobs = [_six(v) for v in np.split(value, cut[1:])] if len(cut) else []
    return pa.table({"b": pa.array(bucket[cut], pa.int64()), "g": pa.array([g] * len(cut), pa.int64()), "names": pa.array(blobs, pa.binary())})


def _names_of(table: pa.Table, span: int, buckets: int) -> pa.Table:
    """Distinct names of a group by bucket."""
    group = Group(table, span)
    own = []
    for data, first, names, starts, count, doc in group.segments():
        # a segment is told by its number of windows, the first and the last of them: it rarely has bytes outside both
        content = _window_names(data, starts, span) ^ mix(_window_names(data, starts + count - 1, span) + count.astype(np.uint64))
        own.append((names, group.ids[first + doc], content))
    return _by_bucket(own, table.column("g")[0].as_py(), buckets)


class Known:
    """Answers of the buckets to a group: shared names, which of them are hot, shared windows of hot names."""

    def __init__(self, table: pa.Table, buckets: int):
        self.buckets = buckets
        names, windows = [], []
        for kind, b, blob in zip(*[table.column(c).to_pylist() for c in ("kind", "b", "names")], strict=True):
            (names if kind == 0 else windows).append((np.uint64(b) << np.uint64(SHORT + 1)) | _from_six(blob))
        all_names = np.sort(np.concatenate(names)) if names else np.empty(0, np.uint64)
        self.names, self.hot = all_names >> np.uint64(1), (all_names & np.uint64(1)).astype(bool)
        self.windows = np.sort(np.concatenate(windows)) >> np.uint64(1) if windows else np.empty(0, np.uint64)

    def find(self, among: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the names are there, their places in ``among``, buckets)."""
        bucket, short = _place(names, self.buckets)
        key = (bucket.astype(np.uint64) << np.uint64(SHORT)) | short
        at = np.minimum(np.searchsorted(among, key), len(among) - 1) if len(among) else np.zeros(len(key), np.int64)
        hit = np.flatnonzero(among[at] == key) if len(among) else np.empty(0, np.int64)
        return hit, at[hit], bucket[hit]


def _spread(starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of every window of the segments."""
    own = np.repeat(np.arange(len(starts)), count)
    return own, starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)


def _hot_windows(docs: pa.Table, answers: pa.Table, span: int, buckets: int) -> pa.Table:
    """Distinct windows of hot names of a group by bucket."""
    found, g = [], docs.column("g")[0].as_py() if docs.num_rows else 0
    if docs.num_rows and answers.num_rows:
        group, known = Group(docs, span), Known(answers, buckets)
        for data, first, names, starts, count, doc in group.segments() if known.hot.any() else ():
            hit, at, _ = known.find(known.names, names)
            hit = hit[known.hot[at]]
            own, places = _spread(starts[hit], count[hit])
            windows = _window_names(data, places, span)
            found.append((windows, group.ids[first + doc[hit][own]], windows))
    return _by_bucket(found, g, buckets)


def _shared(table: pa.Table, hot: int) -> pa.Table:
    """Of each group's names in a bucket, those that several documents hold; the lowest bit says "counts for more
    than ``hot``"."""
    blobs = [_from_six(x) for x in table.column("names").to_pylist()]
    values, sizes = np.concatenate(blobs), np.array([len(x) for x in blobs])
    order = np.argsort(values >> np.uint64(3), kind="stable")
    name = values[order] >> np.uint64(3)
    run = np.cumsum(np.concatenate([[False], name[1:] != name[:-1]]))
    hits = np.bincount(run, 1 + (values[order] & np.uint64(1)))
    keep, many = np.zeros(len(values), bool), np.zeros(len(values), np.uint64)
    keep[order] = (hits > 1)[run]
    load = LOADS[(values[order] >> np.uint64(1) & np.uint64(3)).astype(np.int64)]  # a group names it once
    many[order] = (np.bincount(run, load) > hot)[run]
    answer, cuts = values >> np.uint64(3) << np.uint64(1) | many, np.cumsum(sizes)[:-1]
    parts = [_six(v[k]) for v, k in zip(np.split(answer, cuts), np.split(keep, cuts), strict=True)]
    g, b = table.column("g").to_pylist(), table.column("b").to_pylist()
    rows = [(x, y, p) for x, y, p in zip(g, b, parts, strict=True) if p]
    return pa.table({"g": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()),
                     "names": pa.array([r[2] for r in rows], pa.binary())})


class Chosen:
    """Segments of a group whose names several documents hold, equal ones counted once; of hot names those windows that
    several documents hold.

    Per distinct segment, in order of bucket and then of first place: ``bucket``, ``ids`` (smallest document) and
    ``pieces`` (bytes). ``places`` has per slice (first document, starts, documents,
    numbers of the segments). The same group and answers always give the same order."""

    def __init__(self, group: Group, known: Known):
        number: dict[bytes, int] = {}
        pieces, facts, places = [], [], []
        for data, first, names, starts, count, doc in group.segments() if len(known.names) else ():
            hit, at, bucket = known.find(known.names, names)
            split = known.hot[at]
            starts, count, doc = starts[hit], count[hit], doc[hit]
            if split.any():
                own, single = _spread(starts[split], count[split])
                good, _, b = known.find(known.windows, _window_names(data, single, group.span))
                rest, own = ~split, np.flatnonzero(split)[own[good]]
                order = np.argsort(np.concatenate([np.flatnonzero(rest), own]), kind="stable")  # places in order
                starts, count, doc, bucket = (np.concatenate([x, y])[order] for x, y in (
                    (starts[rest], single[good]), (count[rest], np.ones(len(good), np.int64)), (doc[rest], doc[own]),
                    (bucket[rest], b)))
            nos, fresh = np.empty(len(starts), np.int64), []
            for k, (s, e) in enumerate(zip(starts.tolist(), (starts + count + group.span - 1).tolist(), strict=True)):
                piece = data[s:e]
                nos[k] = number.setdefault(piece, len(pieces))
                if nos[k] == len(pieces):  # documents come in order of id, so the first to hold it is the smallest
                    pieces.append(piece)
                    fresh.append(k)
            facts.append((bucket[fresh], group.ids[first + doc[fresh]]))
            places.append((first, starts, first + doc, nos))
        bucket, ids = (np.concatenate(x) for x in zip(*facts, strict=True)) if pieces else [np.empty(0, np.int64)] * 2
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(pieces), np.int64)
        rank[order] = np.arange(len(pieces))
        self.bucket, self.ids = bucket[order], ids[order]
        self.pieces = [pieces[k] for k in order.tolist()]
        self.places = [(first, start, doc, rank[nos]) for first, start, doc, nos in places]
        self.cuts = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if pieces else np.empty(0, np.int64)


def _segments_of(docs: pa.Table, names: pa.Table, span: int, buckets: int) -> pa.Table:
    """Distinct shared segments of a group, one row per bucket."""
    chosen = Chosen(Group(docs, span), Known(names, buckets)) if docs.num_rows and names.num_rows else None
    g = docs.column("g")[0].as_py() if docs.num_rows else None
    rows: dict[str, list] = {"b": [], "g": [], "ids": [], "sizes": [], "data": []}
    for lo, hi in zip(chosen.cuts, np.append(chosen.cuts[1:], len(chosen.pieces)), strict=True) if chosen else ():
        pieces = chosen.pieces[lo:hi]
        rows["b"].append(int(chosen.bucket[lo]))
        rows["g"].append(g)
        rows["ids"].append(_planes(chosen.ids[lo:hi], "<i8"))
        rows["sizes"].append(_planes(np.array([len(p) for p in pieces]), "<u4"))
        rows["data"].append(b"".join(pieces))
    return pa.table({k: pa.array(v, pa.int64() if k in "bg" else pa.binary()) for k, v in rows.items()})


def smallest_documents(pieces: list[bytes], ids: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, smallest document over all windows equal to it) of every window of the pieces, in order of place."""
    text, starts = join(pieces)
    windows = np.array([len(p) - span + 1 for p in pieces])
    n = int(starts[-1]) + len(pieces[-1]) + 1
    wanted, owner = np.zeros(n, bool), np.repeat(np.arange(len(pieces)), windows)
    at = starts[owner] + np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
    wanted[at] = True
    who = np.zeros(n, np.int64)
    who[at] = ids[owner]
    order = two_stage(text, wanted)
    run = np.flatnonzero(common_prefixes(text, order, span) < span)
    low = np.minimum.reduceat(who[order], run)
    best = np.empty(n, np.int64)
    best[order] = np.repeat(low, np.diff(np.append(run, len(order))))
    return owner, best[at]


def _piece_names(pieces: list[bytes], sizes: np.ndarray, span: int) -> np.ndarray:
    """Names of segments, from their first windows; about a slice of text at a time."""
    ends, out = np.cumsum(sizes), []
    cuts = np.flatnonzero(np.diff(ends // _SLICE, prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pieces)], strict=True):
        starts = ends[lo:hi] - sizes[lo:hi]
        out.append(_windows(np.frombuffer(b"".join(pieces[lo:hi]), np.uint8), span)[starts - starts[0]])
    return np.concatenate(out)


def _gather(which: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of the entries of some lists, which start at ``first`` and have ``count`` entries."""
    many = count[which]
    return np.repeat(first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _resolve(table: pa.Table, span: int) -> pa.Table:
    """Per group and bucket: runs (length, smallest document) over the windows of its segments, in their order."""
    sizes = [_from_planes(x, "<u4").astype(np.int64) for x in table.column("sizes").to_pylist()]
    ids = np.concatenate([_from_planes(x, "<i8") for x in table.column("ids").to_pylist()])
    # equal segments of several groups are one, under their smallest document
    number: dict[bytes, int] = {}
    nos = np.empty(len(ids), np.int64)
    at = 0
    for data, own in zip(table.column("data").to_pylist(), sizes, strict=True):
        lo = 0
        for hi in np.cumsum(own).tolist():
            nos[at] = number.setdefault(data[lo:hi], len(number))
            at, lo = at + 1, hi
    distinct = list(number)
    number.clear()
    least = np.full(len(distinct), NO_ID)
    np.minimum.at(least, nos, ids)
    size = np.array([len(p) for p in distinct])
    names = _piece_names(distinct, size, span)
    order = np.argsort(names, kind="stable")
    kind = names[order]
    # a segment alone under its name has no other to share windows with
    alone = np.concatenate([[True], kind[1:] != kind[:-1]]) & np.concatenate([kind[1:] != kind[:-1], [True]])
    single, order, kind = order[alone], order[~alone], kind[~alone]
    owners, lengths, leasts = [single], [size[single] - span + 1], [least[single]]
    lo = 0
    while lo < len(order):  # whole names together, about a slice at a time
        hi, held = lo, 0
        while hi < len(order) and (held < _SLICE or kind[hi] == kind[hi - 1]):
            held += len(distinct[order[hi]])
            hi += 1
        some = order[lo:hi]
        owner, best = smallest_documents([distinct[k] for k in some.tolist()], least[some], span)
        cut = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])]))
        owners.append(some[owner[cut]])
        lengths.append(np.diff(np.append(cut, len(best))))
        leasts.append(best[cut])
        lo = hi
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    length, low = np.concatenate(lengths)[order], np.concatenate(leasts)[order]
    count = np.bincount(owner, minlength=len(distinct))
    first = np.cumsum(count) - count
    rows: dict[str, list] = {"g": [], "b": [], "runs": [], "lengths": [], "least": []}
    at = 0
    for g, b, own in zip(table.column("g").to_pylist(), table.column("b").to_pylist(), sizes, strict=True):
        mine = nos[at:at + len(own)]
        at += len(own)
        where = _gather(mine, first, count)
        rows["g"].append(g)
        rows["b"].append(b)
        rows["runs"].append(_planes(count[mine], "<u4"))
        rows["lengths"].append(_planes(length[where], "<u4"))
        rows["least"].append(_planes(low[where], "<i8"))
    return pa.table({k: pa.array(v, pa.int64() if k in "gb" else pa.binary()) for k, v in rows.items()})


def _removed(group: Group, answers: pa.Table, span: int, buckets: int) -> list[np.ndarray]:
    """Mask of removed bytes per slice of the group."""
    masks = [np.zeros(sum(map(len, texts)), bool) for _, texts in group.slices()]
    kinds = answers.column("runs").is_null().to_pylist() if answers.num_rows else []
    names = answers.filter(pa.array(kinds, pa.bool_())) if kinds else answers
    runs = answers.filter(pa.array([not k for k in kinds], pa.bool_())).sort_by("b") if kinds else answers
    if not runs.num_rows:
        return masks
    chosen = Chosen(group, Known(names, buckets))
    number, length, least = (np.concatenate([_from_planes(x, kind) for x in runs.column(c).to_pylist()]).astype(np.int64)
                             for c, kind in (("runs", "<u4"), ("lengths", "<u4"), ("least", "<i8")))
    before = np.cumsum(number) - number
    offset = np.cumsum(length) - length
    offset = offset - np.repeat(offset[before], number)  # of a run inside its segment
    firsts = {first: k for k, (first, _) in enumerate(group.slices())}
    for first, start, doc, nos in chosen.places:
        many = number[nos]
        run = np.repeat(before[nos], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        mine = np.repeat(group.ids[doc], many)
        hit = least[run] < mine
        lo = (np.repeat(start, many) + offset[run])[hit]
        edge = np.zeros(len(masks[firsts[first]]) + 1, np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + length[run][hit] + span - 1, -1)
        masks[firsts[first]] = np.cumsum(edge[:-1]) > 0
    return masks


RESULT = StructType([StructField("id", LongType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
                     StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


def _cut(docs: pa.Table, answers: pa.Table, span: int, buckets: int, kind: pa.DataType | None) -> pa.Table:
    """Result rows of a group; with ``kind`` (the type of ``rest``) also what is left and the other columns."""
    group = Group(docs, span) if docs.num_rows else None
    rows: list[list] = [[] for _ in range(6)]
    for (first, texts), gone in zip(group.slices(), _removed(group, answers, span, buckets), strict=True) if group else ():
        at = 0
        for k, t in enumerate(texts):
            m = gone[at:at + len(t)]
            at += len(t)
            n = int(m.sum())
            kept = np.frombuffer(t, np.uint8)[~m].tobytes() if n else t
            spans = int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if n else 0
            text = kept.decode("utf-8", "ignore") if kind is not None else None
            for c, v in zip(rows, (int(group.ids[first + k]), len(t), n, spans, hashlib.sha256(kept).hexdigest(), text), strict=True):
                c.append(v)
    arrays = [pa.array(c, t) for c, t in zip(rows, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
    names = RESULT.names
    if kind is None:
        return pa.table(arrays[:5], names=names)
    rest = docs.column("rest").take(group.order).combine_chunks() if group else pa.array([], kind)
    return pa.table([*arrays, rest], names=[*names, "left", "rest"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN,
                   whole: bool = False, parts: int | None = None) -> DataFrame:
    """One row per document row: id (null: ``NO_ID``), n_bytes, n_removed, n_spans, kept_sha256; with ``whole``
    also ``left`` (text that is left; a character of which only some bytes are left goes) and ``rest`` (whether the text
    is null, and a struct of all columns of the row but the text). ``parts`` forces the number of groups."""
    if span < GRAM + 8:
        raise ValueError(f"span must be at least {GRAM + 8}")
    total = 0 if parts else docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    # a name for about every 18 bytes; 64 names or more in each message from a group to a bucket. What groups have in
    # common is sent by each, so a group holds no less than a slice
    parts = parts or max(1, min(1 << 18, math.isqrt(total // (18 * 64)), total // _SLICE))
    wanted, kind, result = [], None, RESULT
    if whole:
        rest = F.struct(F.col(text).isNull().alias("null"), F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row")).alias("rest")
        wanted = [rest]
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("binary").alias("t"), *wanted)
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("g"), *rows.columns)
    if whole:
        kind = to_arrow_type(rows.schema["rest"].dataType)
        result = StructType([*RESULT.fields, StructField("left", StringType()), rows.schema["rest"]])

    def names_of(t: pa.Table) -> pa.Table:
        return _names_of(t, span, parts)

    def shared_of(t: pa.Table) -> pa.Table:
        return _shared(t, HOT * parts)

    def segments_of(_, a: pa.Table, b: pa.Table) -> pa.Table:
        return _segments_of(a, b, span, parts)

    def resolve(t: pa.Table) -> pa.Table:
        return _resolve(t, span)

    def cut(_, a: pa.Table, b: pa.Table) -> pa.Table:
        return _cut(a, b, span, parts, kind)

    def hot_windows(_, a: pa.Table, b: pa.Table) -> pa.Table:
        return _hot_windows(a, b, span, parts)

    def shared_windows(t: pa.Table) -> pa.Table:
        return _shared(t, 4 * t.num_rows)  # every window has one content: none is hot

    sent, told = "b long, g long, names binary", "g long, b long, names binary"
    names = rows.groupBy("g").applyInArrow(names_of, sent)
    shared = names.groupBy("b").applyInArrow(shared_of, told).withColumn("kind", F.lit(0))
    windows = rows.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(hot_windows, sent)
    shared = shared.unionByName(windows.groupBy("b").applyInArrow(shared_windows, told).withColumn("kind", F.lit(1)))
    segments = (rows.groupBy("g").cogroup(shared.groupBy("g"))
                .applyInArrow(segments_of, "b long, g long, ids binary, sizes binary, data binary"))
    runs = segments.groupBy("b").applyInArrow(resolve, "g long, b long, runs binary, lengths binary, least binary")
    none = F.lit(None).cast("binary")
    answers = (shared.select("g", "b", "kind", "names", none.alias("runs"), none.alias("lengths"), none.alias("least"))
               .unionByName(runs.select("g", "b", F.lit(2).alias("kind"), none.alias("names"), "runs", "lengths", "least")))
    return rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(cut, result)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts; null stays null."""
    left = remove_repeats(docs, doc_id, text, span, True)
    return left.select(*[F.when(~F.col("rest.null"), F.col("left")).alias(c) if c == text else F.col("rest.row")[c].alias(c)
                         for c in docs.columns])


def digest(docs: DataFrame, parts: int | None = None) -> DataFrame:
    return remove_repeats(docs, parts=parts).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
