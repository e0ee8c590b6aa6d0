"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

A rule is (words of a shingle, percent): a document's set holds the distinct shingles of its text (A-Z lower-cased,
words split at ASCII white space; with fewer words the whole sequence is the one shingle), and documents are linked when
any rule finds 100 * intersection >= percent * union. A sketch has ``COORDINATES`` places. In each
round every element is hashed into one place and the smallest (round, value) stays; rounds go on until all
places are filled, and from round ``COORDINATES`` on each round serves one place with all elements, so none
stays empty. Two sets agree in a place with about their Jaccard similarity; equal bands make candidates. All rules share
one pass over the texts, one table of buckets, one verification and one graph.

Documents with equal sets are one node. A bucket is never expanded into pairs. In ``STARS`` rounds every node that still
shares a bucket with another component is compared with one member of such a bucket, and links found merge
components; that settles groups of near copies at one pair per copy and round. What is left are nodes that
share buckets and yet belong to different components: in buckets of at most ``SMALL`` of them all pairs are looked at, a fixed
number per node; in larger ones all pairs that can be similar enough are found exactly, by their rarest shingles.
Pairs whose first ``COMPARED`` places agree less than a link's would with probability ``MISS`` go without a look at
their sets; every other pair is verified on full sets.

Defined results: null and blank texts have empty sets, stand alone and are kept. Rows that share an id are one
document, linked by any of its texts; each row keeps its own set size. A null id sorts after all others and is
returned as null. Extra columns are ignored, whatever their names; an empty table gives an empty result. A very long
text costs its words in one worker, eight bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import NO_ID, slices
from boxlake.operators.components import connected
from boxlake.session import cut, release

SHINGLE = 3
COORDINATES = 192
#: links need 100 * intersection >= PERCENT * union; banding misses one at the threshold with at most this probability
PERCENT, MISS = 85, 1e-6
STARS = 3
#: places that are compared before sets are; nodes of a bucket of which all pairs are looked at
COMPARED, SMALL = 64, 16
Rules = tuple[tuple[int, int], ...]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of the words of texts, cached up to a bound."""

    def __init__(self, max_words: int = 150_000):
        self.known, self.max_words = {}, max_words

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > self.max_words:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Set of a sequence of word hashes."""
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * _ODD + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def key_of(sets: list[np.ndarray]) -> bytes | None:
    """Digest of a document's sets under all rules; null without words."""
    return hashlib.blake2b(b"".join(s.tobytes() for s in sets), digest_size=16).digest() if len(sets[0]) else None


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.uint64(0xFFFFFFFF)
    out, n, i = np.full(t, empty), len(elements), 0
    block = max(1, 512 // n)
    while i < t and (out == empty).any():
        rounds = np.arange(i, min(t, i + block), dtype=np.uint64)
        h = mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _ODD)
        place = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        value = (rounds[:, None] << np.uint64(32)) | (h & low)
        np.minimum.at(out, place.ravel().astype(np.intp), value.ravel())
        i += block
    for j in np.flatnonzero(out == empty):
        h = mix(elements + np.uint64((t + int(j) + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        out[j] = (np.uint64(t + int(j)) << np.uint64(32)) | (h & low).min()
    return out


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows of each): the most rows at which a link at the threshold is missed with at most ``MISS``."""
    fits = [r for r in range(1, COORDINATES + 1) if (1 - (percent / 100) ** r) ** (COORDINATES // r) <= MISS]
    rows = max(fits, default=1)
    return COORDINATES // rows, rows


def band_keys(sketches: np.ndarray, bands: int, rows: int, rule: int = 0) -> np.ndarray:
    """[documents, bands] keys; the number of the band is part of the key, the rule stands in the lowest three bits."""
    s = sketches[:, :bands * rows].reshape(len(sketches), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2])
    for r in range(rows):
        h = mix(h * _ODD + s[:, :, r])
    return h & ~np.uint64(7) | np.uint64(rule)


@cache
def least_agreement(percent: int) -> int:
    """Places of ``COMPARED`` that agree at a link, but with probability ``MISS``."""
    p, below, k = percent / 100, 0.0, 0
    while True:
        below += comb(COMPARED, k) * p ** k * (1 - p) ** (COMPARED - k)
        if below > MISS:
            return k
        k += 1


def fingerprints(docs: DataFrame, doc_id: str, text: str, rules: Rules) -> DataFrame:
    """One row per document row: id (null: ``NO_ID``), key (digest of the sets), and per rule n (set size), bands, and
    one byte of each of the first ``COMPARED`` places of the sketch."""
    shapes = [banding(percent) for _, percent in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, "t"):
            sets = [[shingles(w, size) for size, _ in rules] for w in (words.of(t or "") for t in b.column("t").to_pylist())]
            full = [k for k, s in enumerate(sets) if len(s[0])]
            bands: list = [None] * len(sets)
            places: list = [None] * len(sets)
            if full:
                sketches = [np.stack([sketch(sets[k][r]) for k in full]) for r in range(len(rules))]
                keys = np.concatenate([band_keys(s, *shape, r) for r, (s, shape) in enumerate(zip(sketches, shapes, strict=True))], axis=1)
                low = np.concatenate([mix(s[:, :COMPARED]).astype(np.uint8) for s in sketches], axis=1)
                for k, row, own in zip(full, keys.view(np.int64), low, strict=True):
                    bands[k], places[k] = row, own.tobytes()
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array([key_of(s) for s in sets], pa.binary()), pa.array([[len(x) for x in s] for s in sets], pa.list_(pa.int64())),
                pa.array(bands, pa.list_(pa.int64())), pa.array(places, pa.binary())], ["id", "key", "n", "bands", "places"])

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "id long, key binary, n array<long>, bands array<long>, places binary")


def word_table(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, rules: Rules) -> DataFrame:
    """(node, w): word hashes as bytes of the nodes of (node, id, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, "t"):
            own = [words.of(t or "") for t in b.column("t").to_pylist()]
            keys = pa.array([key_of([shingles(w, size) for size, _ in rules]) for w in own], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), keys, pa.array([w.tobytes() for w in own], pa.binary())], ["id", "key", "w"])

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("t"))
    some = rows.join(nodes.select("id").distinct(), "id", "left_semi").mapInArrow(run, "id long, key binary, w binary")
    # rows of one id and one text are one node
    return some.join(nodes.select("node", "id", "key"), ["id", "key"]).groupBy("node").agg(F.first("w").alias("w"))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


#: two nodes, the smaller one first, and their labels
PAIR, LINK = ["a", "b", "ra", "rb"], "a long, b long, ra long, rb long"


def verified(pairs: DataFrame, words: DataFrame, rules: Rules) -> DataFrame:
    """Pairs whose full sets are similar enough under some rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "wa"):
            both = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                    for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist(), strict=True))
            mask = pa.array([any(similar(shingles(x, size), shingles(y, size), percent) for size, percent in rules) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(mask) for c in PAIR], PAIR)

    left = words.select(F.col("node").alias("a"), F.col("w").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("w").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select(*PAIR, "wa", "wb").mapInArrow(run, LINK)


def alike(pairs: DataFrame, facts: DataFrame, rules: Rules) -> DataFrame:
    """Pairs whose set sizes and sketches some rule allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, len(rules), COMPARED) for c in ("pa", "pb"))
            m, n = (np.array(b.column(c).to_pylist()) for c in ("na", "nb"))
            keep = np.zeros(b.num_rows, bool)
            for r, (_, percent) in enumerate(rules):
                sizes = 100 * np.minimum(m[:, r], n[:, r]) >= percent * np.maximum(m[:, r], n[:, r])
                keep |= sizes & ((x[:, r] == y[:, r]).sum(axis=1) >= least_agreement(percent))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(mask) for c in PAIR], PAIR)

    side = lambda s: facts.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("places").alias(f"p{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, LINK)


def _ordered(x: DataFrame) -> DataFrame:
    """(u, v, root_u, root_v) with the smaller node first."""
    first = F.col("u") < F.col("v")
    return x.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.when(first, F.col("root_u")).otherwise(F.col("root_v")).alias("ra"),
                    F.when(first, F.col("root_v")).otherwise(F.col("root_u")).alias("rb"))


def _pairs(x: DataFrame) -> DataFrame:
    """Distinct pairs of (u, v, root_u, root_v)."""
    return _ordered(x).distinct()


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several labels."""
    several = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return cut(members.join(several, "bucket", "left_semi"))


def links(members: DataFrame, facts: DataFrame, words: DataFrame, found: DataFrame, rules: Rules) -> DataFrame:
    """Components over all similar pairs and those ``found`` before: (node, root). ``members``: (bucket, node, n);
    ``facts``: (node, n, places); ``words``: (node, w).

    Between rounds nodes carry labels: a link gives the members of the larger label the smaller one. Labels spare
    comparisons within a component and may lag behind it; the components are found once, from all links."""
    rest = members.withColumn("root", F.col("node"))
    for turn in range(STARS + 1):
        # what is settled stays settled
        if turn < STARS:
            met = _meet(rest, turn)
            rest, pairs = met.select("bucket", "node", "n", "root"), alike(_star(met, rules), facts, rules)
        else:
            rest = _open(rest)
            pairs = alike(_left_pairs(rest, words, rules), facts, rules)
        new = cut(verified(pairs, words, rules))
        release(words.sparkSession)
        if new.isEmpty():
            continue
        found = new.select("a", "b") if found.isEmpty() else found.unionByName(new.select("a", "b"))
        if turn < STARS:
            merged = new.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("to"))
            rest = rest.join(merged, "root", "left").select("bucket", "node", "n", F.coalesce("to", "root").alias("root"))
    if found.isEmpty():
        return found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    nodes = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    return connected(nodes, found, [], "node").select("node", "root")


def _percent(rules: Rules) -> Column:
    """Percent of a bucket's rule."""
    return F.element_at(F.array(*[F.lit(p) for _, p in rules]), (F.col("bucket").bitwiseAND(7) + 1).cast("int"))


def _meet(rest: DataFrame, turn: int) -> DataFrame:
    """Members of buckets that hold several labels, each with one node of its bucket (o, v, hub_n, hub_root).
    The first round takes the smallest nodes, later ones draw anew by hash."""
    order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    hubs = (rest.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "node", "n", "root")).alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .where("lo <> hi").select("bucket", F.col("h.o").alias("o"), F.col("h.node").alias("v"), F.col("h.n").alias("hub_n"), F.col("h.root").alias("hub_root")))
    return cut(rest.join(hubs, "bucket"))


def _star(met: DataFrame, rules: Rules) -> DataFrame:
    """One pair per open node and round: with one member of one of its buckets, of another label. The member
    comes before the node in the round's order, so no pair comes twice."""
    fits = (100 * F.least("n", "hub_n") >= _percent(rules) * F.greatest("n", "hub_n")) & (F.col("root") != F.col("hub_root"))
    best = (met.where(fits).groupBy(F.col("node").alias("u"))
            .agg(F.min(F.struct("o", "v", F.col("hub_root").alias("root_v"), F.col("root").alias("root_u"))).alias("h")))
    return _ordered(best.select("u", "h.v", "h.root_u", "h.root_v"))


def _left_pairs(rest: DataFrame, words: DataFrame, rules: Rules) -> DataFrame:
    """Distinct pairs of open nodes of two labels: all of a bucket of at most ``SMALL`` nodes, those that the rarest shingles
    bring together in larger ones."""
    sizes = cut(rest.groupBy("bucket").agg(F.count("*").alias("many")))
    few = rest.join(sizes.where(F.col("many") <= SMALL).select("bucket"), "bucket", "left_semi")
    u, v = (few.select("bucket", F.col("node").alias(s), F.col("root").alias(f"root_{s}"), F.col("n").alias(f"n_{s}")) for s in "uv")
    fits = 100 * F.least("n_u", "n_v") >= _percent(rules) * F.greatest("n_u", "n_v")
    pairs = cut(_pairs(u.join(v, "bucket").where((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & fits).select("u", "v", "root_u", "root_v")))
    hot = sizes.where(F.col("many") > SMALL).select("bucket")
    if hot.isEmpty():
        return pairs
    many = cut(rest.join(hot, "bucket", "left_semi"))
    for r, rule in enumerate(rules):
        release(rest.sparkSession)
        pairs = pairs.unionByName(cut(_prefix_pairs(many.where(F.col("bucket").bitwiseAND(7) == r), words, *rule)))
    return pairs.distinct()


def _prefix_pairs(rest: DataFrame, words: DataFrame, size: int, percent: int) -> DataFrame:
    """All pairs of open nodes of two labels that can be similar enough, and few others.

    In the order of rarest shingles first, two similar sets share one among the first n - ceil(p n) + 1 of the
    larger and the first n - ceil(2p / (1 + p) n) + 1 of the smaller (p = percent / 100), and the first one they share
    leaves enough of both behind it. Shingles of one node or one label make no pair; they come before all others and are
    only counted, so copies that differ by their own edits meet only if they are near enough."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "w"):
            own = [shingles(np.frombuffer(w, np.uint64), size).view(np.int64) for w in b.column("w").to_pylist()]
            if own:
                count = [len(s) for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(c).to_numpy(), count)) for c in ("node", "root")]
                                                 + [pa.array(np.concatenate(own))], ["node", "root", "x"])

    open_ = cut(rest.select("node", "n", "root").distinct())
    rows = cut(open_.join(words, "node").select("node", "root", "w").mapInArrow(elements, "node long, root long, x long"))
    spread = rows.groupBy("x").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("x", "df")
    shared = rows.select("node", "x").join(spread, "x").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("xs"))  # a node's own set, no more
    ranked = cut(shared.join(open_, "node"))
    n, p, alone = F.col("n"), F.lit(percent), F.col("n") - F.size("xs")
    probe = n - F.ceil(n * p / 100) + 1
    index = n - F.ceil(2 * n * p / (100 + p)) + 1

    def heads(length, name: str) -> DataFrame:
        head = ranked.select("node", "n", "root", alone.alias("alone"), F.posexplode(F.slice("xs", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int"))).alias("at", "e"))
        return head.select(F.col("e.x").alias("x"), F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("root").alias(f"root_{name}"),
                           (F.col("n") - F.col("alone") - F.col("at")).alias(f"left_{name}"))

    both = heads(index, "u").join(heads(probe, "v"), "x")
    # all that two sets share lies at or behind the first shingle they share
    enough = (100 + p) * F.least("left_u", "left_v") >= p * (F.col("n_u") + F.col("n_v"))
    near = (F.col("n_u") <= F.col("n_v")) & (100 * F.col("n_u") >= p * F.col("n_v")) & (F.col("root_u") != F.col("root_v")) & enough
    return _pairs(both.where(near).select("u", "v", "root_u", "root_v"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = ((SHINGLE, PERCENT),)) -> DataFrame:
    """One row per document row: id (null: ``NO_ID``), n (set size under the first rule), component (smallest id reachable)."""
    prints = cut(fingerprints(docs, doc_id, text, rules))
    alone = prints.where("key is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    full = prints.where("key is not null")
    # one node per distinct text, numbered in order of its smallest id, so that smallest nodes are smallest ids
    reps = full.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("places").alias("places"))
    reps = cut(reps.repartitionByRange("id", "key").sortWithinPartitions("id", "key").withColumn("node", F.monotonically_increasing_id()))
    at = F.element_at("n", (F.col("bucket").bitwiseAND(7) + 1).cast("int"))
    rows = reps.select("node", "n", F.explode("bands").alias("bucket")).select("bucket", "node", at.alias("n"))
    busy = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = cut(rows.join(busy, "bucket", "left_semi"))
    facts = cut(reps.select("node", "id", "key", "n", "places").join(members.select("node").distinct(), "node", "left_semi"))
    words = cut(word_table(docs, facts, doc_id, text, rules))
    release(docs.sparkSession)
    # texts of one id are one document: all hang on its smallest node
    named = full.select("id", "key").distinct()
    twice = named.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    texts = cut(named.join(twice, "id", "left_semi").join(reps.select("key", "node"), "key").select("id", "node"))
    same = texts.select(F.col("node").alias("a"), F.col("node").alias("b"))
    if not texts.isEmpty():
        same = texts.join(texts.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b"))
    # through Arrow, as other links are: what the planner infers of joined columns breaks its union of checkpoints
    same = same.mapInArrow(lambda batches: batches, "a long, b long")
    roots = links(members, facts, words, cut(same), rules)
    # a root is the smallest node of its component, and the smallest node has the smallest id
    lowest = reps.select(F.col("node").alias("root"), F.col("id").alias("low"))
    known = (reps.select("key", "node", F.col("id").alias("own")).join(roots.join(lowest, "root").select("node", "low"), "node", "left")
             .select("key", F.coalesce("low", "own").alias("component")))
    return full.select("id", F.get("n", F.lit(0)).alias("n"), "key").join(known, "key").select("id", "n", "component").unionByName(alone)


def digest(docs: DataFrame) -> DataFrame:
    found = components(docs)
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = ((SHINGLE, PERCENT),)) -> DataFrame:
    """The documents that are the smallest id of their component; of rows with equal id and text one is kept, the first in
    order of all columns. Documents are linked when any rule links them."""
    kept = cut(components(docs, doc_id, text, rules).where("id = component").select("id").distinct())
    release(docs.sparkSession)  # before the documents themselves travel
    whole = F.struct(*[F.col(c) for c in docs.columns])
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.md5(F.col(text).cast("binary")).alias("t"), whole.alias("row"))
    first = keyed.join(kept, "id", "left_semi").groupBy("id", "t").agg(F.min("row").alias("row"))
    return first.select(*[F.col("row")[c].alias(c) for c in docs.columns])
