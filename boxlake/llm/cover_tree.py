"""Near-duplicate vectors: all pairs above a cosine, by dual traversal of cover trees.

On unit vectors a cosine is a distance (``reach``). A tree has nested levels whose radii halve: a node's children
are centres that keep a level's radius apart and cover its rows, its own centre is among them, and each node knows
how far its rows really lie from the centre. Two trees are walked together, pair of nodes by pair of nodes: a pair
whose balls are further apart than the reach is dropped, a pair that lies within the reach as a whole is linked
without looking at its rows, any other is opened. What is left are single rows, decided by their cosines. So the pairs
are exact, and only bounds save work.

The upper levels are tables: a label's rows are cut into cells by their nearest centre, drawn from a bounded sample of
the cell, again and again until a cell is small or lies within the reach as a whole. All rows go to a cell, the sample
decides on shapes only, never on links. A centre that is nearest to most rows (a vector amid its near copies) would leave
the cell as it was: its rows within half the reach become a cell of their own, the others are dealt out. So the levels
are few. Cells are walked as pairs too, level by level; the pairs left are jobs on blocks of at most ``CELL`` rows, each
with the lower levels of its tree.

Equal vectors are one node with a count. No list of pairs exists: a job returns one row per vector that has links, with
their number and one neighbour towards the job's smallest, which is enough for components.

Defined results: rows meet only if their labels are equal and not null and their vectors have equal length. Vectors
that are null, empty or zero, or hold null or non-finite components, link with nothing. Rows of one id are vectors of
their own. A null id sorts last and is returned as null. Extra columns are ignored; an empty table gives an empty
result. Very long vectors make blocks of ``CELL`` such vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from boxlake.llm.common import NO_ID
from boxlake.operators.components import connected
from boxlake.operators.ranking import top_n
from boxlake.session import cut, settled

COSINE = 0.98
#: rows of a block; rows of a cell that its centres are drawn from; most centres of a cell; rows of a leaf
CELL, SAMPLE, CENTRES, LEAF = 2048, 256, 64, 32
#: more than rounding can move a distance; pairs within it of a bound are opened
SLACK = 1e-6
_STRIP = 512


def reach(cosine: float) -> float:
    """Distance of unit vectors with the cosine."""
    return math.sqrt(2 - 2 * cosine)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, whether the row has a direction)."""
    x = x.astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        scale = np.abs(x).max(axis=1, initial=0)
        good = np.isfinite(scale) & (scale > 0) & np.isfinite(x).all(axis=1)
        x = np.where(good[:, None], x / np.where(good, scale, 1)[:, None], 0)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(good, norm, 1)[:, None], good


def load(blobs: list[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1))[0]


def net(x: np.ndarray, radius: float, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centres, number of each row's centre): centres are more than ``radius`` apart and cover all rows."""
    owner, best = np.full(len(x), -1), np.full(len(x), np.inf)
    centres, at, open_ = [], first, np.ones(len(x), bool)
    while at >= 0:
        d = distances(x, x[at:at + 1])[:, 0]
        d[at] = 0
        nearer = d < best
        owner[nearer], best[nearer] = len(centres), d[nearer]
        centres.append(at)
        open_ &= d > radius
        at = int(open_.argmax()) if open_.any() else -1
    return np.array(centres), owner


def radius_below(r: float) -> float:
    """Radius of the first level that is finer than ``r``: a power of two."""
    return 2.0 ** (math.ceil(math.log2(r)) - 1)


@dataclass
class Tree:
    """Lower levels: nodes in order of breadth, each with the rows lo to hi, its centre in front."""

    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    kids: np.ndarray  # first child, number of children

    def centres(self, nodes: np.ndarray) -> np.ndarray:
        return self.x[self.lo[nodes]]

    def open(self, node: int) -> np.ndarray:
        first, count = self.kids[node]
        return np.arange(first, first + count) if count else np.array([node])


def grow(x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """(tree, order of the rows in it)."""
    order = np.arange(len(x))
    lo, hi, radius, kids, at = [0], [len(x)], [], [], 0
    while at < len(lo):
        a, b = lo[at], hi[at]
        own = x[order[a:b]]
        far = distances(own, own[:1])[:, 0]
        far[0] = 0
        r = float(far.max())
        radius.append(r)
        if b - a <= leaf or r < SLACK:
            kids.append((0, 0))
        else:
            centres, owner = net(own, radius_below(r))
            front = np.ones(b - a, bool)
            front[centres] = False  # a centre comes first among its rows
            by = np.lexsort((front, owner))
            order[a:b] = order[a:b][by]
            ends = a + np.cumsum(np.bincount(owner, minlength=len(centres)))
            kids.append((len(lo), len(centres)))
            lo += [a, *ends[:-1].tolist()]
            hi += ends.tolist()
        at += 1
    return Tree(x[order], np.array(lo), np.array(hi), np.array(radius), np.array(kids)), order


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component over the links (a, b)."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            break
    return low


class Walk:
    """Dual traversal of two trees (or of one with itself): per row the weight it is linked with, and a forest."""

    def __init__(self, left: Tree, right: Tree | None, w_left: np.ndarray, w_right: np.ndarray, cosine: float):
        self.a, self.b, self.same, self.cosine, self.t = left, right or left, right is None, cosine, reach(cosine)
        self.wa, self.wb, self.n = w_left, w_right, len(left.x)
        self.shift = 0 if self.same else self.n
        self.ga, self.gb = np.zeros(self.n, np.int64), np.zeros(len(self.b.x), np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.visited = 0
        open_ = [(0, 0)]
        while open_:
            open_ += self._pair(*open_.pop())
        if self.same:
            self.ga += self.gb
        ends = [np.concatenate(x) for x in zip(*self.links, strict=True)] if self.links else [np.empty(0, np.int64)] * 2
        self.low = forest(self.n + (0 if self.same else len(self.b.x)), *ends)

    def _pair(self, i: int, j: int) -> list[tuple[int, int]]:
        a, b, own = self.a, self.b, self.same and i == j
        if not a.kids[i][1] and not b.kids[j][1]:
            rows, others = np.arange(a.lo[i], a.hi[i]), np.arange(b.lo[j], b.hi[j])
            self._rows(rows, others, own)
            return []
        left, right = a.open(i), b.open(j)
        more = []
        for s in range(0, len(left), _STRIP):
            part = left[s:s + _STRIP]
            ca, cb = a.centres(part), b.centres(right)
            self.visited += len(part) * len(right)
            reach_of = a.radius[part][:, None] + b.radius[right]
            d = distances(ca, cb)
            # the same tree meets itself: each pair of nodes once, a node with itself is opened
            once = part[:, None] < right if own else np.ones(d.shape, bool)
            one = (a.hi - a.lo)[part][:, None] * (b.hi - b.lo)[right] == 1
            whole = once & ~one & (d + reach_of <= self.t - SLACK)
            rest = once & ~one & ~whole & (d <= reach_of + self.t + SLACK)
            for p, q in zip(*np.nonzero(whole), strict=True):
                self._all(part[p], right[q])
            more += [(int(part[p]), int(right[q])) for p, q in zip(*np.nonzero(rest), strict=True)]
            if own:
                more += [(int(k), int(k)) for k in part if a.hi[k] - a.lo[k] > 1]
            if (once & one).any():
                self._links(a.lo[part], b.lo[right], once & one & (ca @ cb.T >= self.cosine))
        return more

    def _rows(self, rows: np.ndarray, others: np.ndarray, own: bool) -> None:
        for s in range(0, len(rows), _STRIP):
            part = rows[s:s + _STRIP]
            near = self.a.x[part] @ self.b.x[others].T >= self.cosine
            self.visited += near.size
            self._links(part, others, near & (part[:, None] < others) if own else near)

    def _links(self, rows: np.ndarray, others: np.ndarray, near: np.ndarray) -> None:
        p, q = np.nonzero(near)
        if len(p):
            self.ga[rows] += near @ self.wb[others]
            self.gb[others] += self.wa[rows] @ near
            # of many links a forest is kept
            low = forest(len(rows) + len(others), p, q + len(rows))
            name = np.concatenate([rows, others + self.shift])
            self.links.append((name, name[low]))

    def _all(self, i: int, j: int) -> None:
        rows, others = np.arange(self.a.lo[i], self.a.hi[i]), np.arange(self.b.lo[j], self.b.hi[j])
        self.ga[rows] += self.wb[others].sum()
        self.gb[others] += self.wa[rows].sum()
        name = np.concatenate([rows, others + self.shift])
        self.links.append((name, np.where(np.arange(len(name)) < len(rows), name[len(rows)], name[0])))


def vectors(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(id, key, g, v): v is null for rows that link with nothing; equal keys mean equal label and vector."""
    kind = "<f4" if isinstance(df.schema[embedding].dataType.elementType, FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("e")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(column.flatten().cast(pa.float32() if kind == "<f4" else pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            starts, labels = np.cumsum(sizes) - sizes, b.column("label").to_pylist()
            v: list = [None] * b.num_rows
            for d in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == d)
                x = flat[starts[rows][:, None] + np.arange(d)] + np.float32(0)  # -0 becomes 0
                for k, ok, own in zip(rows.tolist(), unit(x)[1].tolist(), x.astype(kind), strict=True):
                    if ok and labels[k] is not None:
                        v[k] = own.tobytes()
            g = [None if x is None else f"{len(x)}:{y}" for x, y in zip(v, labels, strict=True)]
            key = [None if x is None else hashlib.blake2b(f"{y}|".encode() + x, digest_size=16).digest() for x, y in zip(v, g, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(key, pa.binary()), pa.array(g, pa.string()), pa.array(v, pa.binary())],
                                             ["id", "key", "g", "v"])

    rows = df.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label).cast("string").alias("label"),
                     F.col(embedding).alias("e"))
    return rows.mapInArrow(run, "id long, key binary, g string, v binary")


def spread(x: np.ndarray, wanted: int, ball: float) -> tuple[np.ndarray, int, float]:
    """(centres, the one that is nearest to most rows or -1, share of the rows that lie there beyond ``ball``).

    Of the coarsest level that has as many centres as wanted (of a finer level the first ones) and leaves at most half of the
    rows beyond the ball of one centre; if there is none, of the level that leaves the fewest."""
    best: tuple[np.ndarray, int, float] | None = None
    r, centres = float(distances(x, x[:1]).max()), np.array([0])
    while True:
        if len(centres) >= wanted or r <= SLACK:
            if len(centres) < 2:  # nearer than rounding tells apart: any cut will do, bounds are measured
                centres = np.arange(wanted)
            own = centres[:wanted]
            others = np.setdiff1d(np.arange(len(x)), own)
            rows = others if len(others) else own
            d = distances(x[rows], x[own])
            to = d.argmin(axis=1)
            shares = np.bincount(to, minlength=len(own)) / len(rows)
            beyond = np.bincount(to[d[np.arange(len(rows)), to] > ball], minlength=len(own)) / len(rows)
            if best is None or beyond.max() < best[2]:
                hub = int(shares.argmax()) if beyond.max() <= 0.5 else int(beyond.argmax())
                best = own, hub if shares[hub] > 0.5 else -1, float(beyond.max())
        if best is not None and best[2] <= 0.5 or r <= SLACK or len(centres) == len(x):
            return best[0], best[1], best[2]
        r = radius_below(r)
        centres, _ = net(x, r)


def _split(rows: DataFrame, sizes: DataFrame, kind: str, cosine: float, cell: int) -> DataFrame:
    """Rows of large cells with the cell of their nearest centre, the centre and the distance."""
    some = top_n(rows.select("cell", "node", "v"), ["cell"], [F.xxhash64("node"), F.col("node")], SAMPLE)
    ball = (reach(cosine) - SLACK) / 2

    def choose(t: pa.Table) -> pa.Table:
        """Centres, and the pieces that the rows beyond the ball of the hub are dealt to."""
        blobs, size = t.column("v").to_pylist(), t.column("size")[0].as_py()
        centres, hub, beyond = spread(load(blobs, kind), min(CENTRES, 2 * -(-size // cell), len(blobs)), ball)
        pieces = min(CENTRES, math.ceil(2 * beyond * size / cell)) if beyond > 0.5 else 1
        return pa.table({"cell": [t.column("cell")[0].as_py()], "centres": [b"".join(blobs[k] for k in centres.tolist())],
                         "count": [len(centres)], "hub": [hub], "pieces": [pieces]})

    chosen = cut(some.join(sizes, "cell").groupBy("cell").applyInArrow(choose, "cell string, centres binary, count long, hub long, pieces long"))
    parts = F.ceil(F.col("size") / (8 * cell)).cast("int")
    dealt = rows.join(sizes.select("cell", parts.alias("parts")), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sent = chosen.join(sizes.select("cell", parts.alias("parts")), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def assign(_, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return a.select(["cell", "node", "id", "n", "v"]).slice(0, 0).append_column("parent", pa.array([], pa.string())).append_column(
                "centre", pa.array([], pa.binary())).append_column("far", pa.array([], pa.float64()))
        name, count, blob = a.column("cell")[0].as_py(), b.column("count")[0].as_py(), b.column("centres")[0].as_py()
        hub, pieces = b.column("hub")[0].as_py(), b.column("pieces")[0].as_py()
        blobs = [blob[k * len(blob) // count:(k + 1) * len(blob) // count] for k in range(count)]
        d = distances(load(a.column("v").to_pylist(), kind), load(blobs, kind))
        own = d.argmin(axis=1)
        far, nth = d[np.arange(len(own)), own], own.copy()
        out = np.flatnonzero((own == hub) & (far > ball))
        nth[out[np.argsort(a.column("node").to_numpy()[out])]] = count + np.arange(len(out)) % pieces
        return pa.table({"cell": [f"{name}.{k}" for k in nth.tolist()], "node": a.column("node"), "id": a.column("id"), "n": a.column("n"),
                         "v": a.column("v"), "parent": [name] * a.num_rows, "centre": [blobs[k] for k in own.tolist()], "far": far})

    return dealt.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInArrow(
        assign, "cell string, node long, id long, n long, v binary, parent string, centre binary, far double")


def cells(nodes: DataFrame, kind: str, cosine: float, cell: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their cell, upper tree, levels). The upper tree: (parent, cell, centre, far, size, leaf)."""
    t = reach(cosine)
    rows = nodes.select(F.col("g").alias("cell"), "node", "id", "n", "v")
    sizes = cut(rows.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"))
    none = F.lit(None)
    tree = sizes.select(none.cast("string").alias("parent"), "cell", none.cast("binary").alias("centre"), F.lit(2.0).alias("far"), "size",
                        (F.col("size") <= cell).alias("leaf"))
    done, levels = rows.join(sizes.where(F.col("size") <= cell), "cell", "left_semi"), 0
    large = sizes.where(F.col("size") > cell)
    while not large.isEmpty():
        rows = settled(_split(rows.join(large, "cell", "left_semi"), large, kind, cosine, cell))
        found = cut(rows.groupBy("cell").agg(F.first("parent").alias("parent"), F.first("centre").alias("centre"), F.max("far").alias("far"),
                                             F.count("*").alias("size")))
        within = (F.col("size") <= cell) | (2 * F.col("far") <= t - SLACK)
        tree = tree.unionByName(found.withColumn("leaf", within))
        rows = rows.select("cell", "node", "id", "n", "v")
        large = found.where(~within).select("cell", "size")
        done = done.unionByName(rows.join(found.where(within), "cell", "left_semi"))
        levels += 1
    return cut(done), cut(tree), levels


def _meeting(tree: DataFrame, levels: int, kind: str, cosine: float) -> DataFrame:
    """(a, b, whole): pairs of leaf cells that the bounds leave, level by level from the labels down."""
    t = reach(cosine)
    schema = "a string, b string, leaf_a boolean, leaf_b boolean, whole boolean"
    pairs = tree.where("parent is null").select(F.col("cell").alias("a"), F.col("cell").alias("b"), F.col("leaf").alias("leaf_a"),
                                                F.col("leaf").alias("leaf_b"), F.lit(False).alias("whole"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            left, right = b.column("ca").to_pylist(), b.column("cb").to_pylist()
            # cells without a centre are labels: they meet themselves alone and have no children to compare
            bare = [x is None or y is None for x, y in zip(left, right, strict=True)]
            d = np.zeros(b.num_rows)
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                if not bare[k]:
                    d[k] = float(distances(load([x], kind), load([y], kind))[0, 0])
            both = b.column("fa").to_numpy() + b.column("fb").to_numpy()
            same = np.array([x == y for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)], bool)
            d = np.where(same, 0, d)
            keep, whole = pa.array(d <= both + t + SLACK), pa.array((d + both <= t - SLACK) & ~np.array(bare, bool))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("a", "b", "leaf_a", "leaf_b")], whole],
                                             ["a", "b", "leaf_a", "leaf_b", "whole"]).filter(keep)

    for _ in range(levels):
        # a leaf stays as it is while others are opened
        kids = tree.where("parent is not null").select("parent", "cell", "centre", "far", "leaf").unionByName(
            tree.where("leaf").select(F.col("cell").alias("parent"), "cell", "centre", "far", "leaf"))
        side = lambda s: kids.select(F.col("parent").alias(s), F.col("cell").alias(f"new_{s}"), F.col("centre").alias(f"c{s}"),
                                     F.col("far").alias(f"f{s}"), F.col("leaf").alias(f"new_leaf_{s}"))
        grown = pairs.where("not whole").join(side("a"), "a").join(side("b"), "b").where("a <> b or new_a <= new_b")
        grown = grown.select(F.col("new_a").alias("a"), F.col("new_b").alias("b"), "ca", "cb", "fa", "fb", F.col("new_leaf_a").alias("leaf_a"),
                             F.col("new_leaf_b").alias("leaf_b"))
        pairs = cut(pairs.where("whole").unionByName(grown.mapInArrow(bound, schema)))
    return pairs.select("a", "b", "whole")


OUT = "node long, links long, id long, to_id long, to_node long"


def links(nodes: DataFrame, kind: str, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """One row per node and job that has links: number of vectors, and one node of its component.
    ``nodes``: (node, id, n, g, v), vectors distinct within g."""
    rows, tree, levels = cells(nodes, kind, cosine, cell)
    pairs = cut(_meeting(tree, levels, kind, cosine))
    # a cell that lies within the reach as a whole may be large: its blocks are dealt by hash
    dealt = rows.join(tree.where("leaf").select("cell", F.ceil(F.col("size") / cell).cast("int").alias("parts")), "cell")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def block(t: pa.Table) -> pa.Table:
        blobs = t.column("v").to_pylist()
        tree, order = grow(load(blobs, kind))
        shape = np.concatenate([tree.lo, tree.hi, tree.kids[:, 0], tree.kids[:, 1]]).astype("<i4")
        facts = np.stack([t.column(c).to_numpy()[order] for c in ("node", "id", "n")]).astype("<i8")
        return pa.table({"cell": [t.column("cell")[0].as_py()], "part": pa.array([t.column("part")[0].as_py()], pa.int32()),
                         "shape": [shape.tobytes()], "radius": [tree.radius.tobytes()], "facts": [facts.tobytes()],
                         "v": [b"".join(blobs[k] for k in order.tolist())]})

    blocks = cut(dealt.select("cell", "part", "node", "id", "n", "v").groupBy("cell", "part").applyInArrow(
        block, "cell string, part int, shape binary, radius binary, facts binary, v binary"))
    parts = blocks.select("cell", "part")
    jobs = (pairs.where("not whole").join(parts.select(F.col("cell").alias("a"), F.col("part").alias("pa")), "a")
            .join(parts.select(F.col("cell").alias("b"), F.col("part").alias("pb")), "b").where("a <> b or pa <= pb"))
    key = ["a", "pa", "b", "pb"]
    body = ["shape", "radius", "facts", "v"]
    left = jobs.join(blocks.select(F.col("cell").alias("a"), F.col("part").alias("pa"), *body), ["a", "pa"]).select(*key, F.lit(0).alias("side"), *body)
    right = (jobs.where("a <> b or pa <> pb").join(blocks.select(F.col("cell").alias("b"), F.col("part").alias("pb"), *body), ["b", "pb"])
             .select(*key, F.lit(1).alias("side"), *body))

    def read(t: pa.Table, k: int) -> tuple[Tree, np.ndarray]:
        radius = np.frombuffer(t.column("radius")[k].as_py())
        lo, hi, first, count = np.frombuffer(t.column("shape")[k].as_py(), "<i4").astype(np.int64).reshape(4, -1)
        facts = np.frombuffer(t.column("facts")[k].as_py(), "<i8").reshape(3, -1)
        x = unit(np.frombuffer(t.column("v")[k].as_py(), kind).reshape(facts.shape[1], -1))[0]
        return Tree(x, lo, hi, radius, np.stack([first, count], axis=1)), facts

    def work(t: pa.Table) -> pa.Table:
        sides = {s: read(t, k) for k, s in enumerate(t.column("side").to_pylist())}
        (ta, fa), (tb, fb) = sides[0], sides.get(1, (None, None))
        walk = Walk(ta, tb, fa[2], fa[2] if fb is None else fb[2], cosine)
        facts, got = (fa, walk.ga) if fb is None else (np.concatenate([fa, fb], axis=1), np.concatenate([walk.ga, walk.gb]))
        hit = np.flatnonzero(got)
        to = walk.low[hit]
        return pa.table({"node": facts[0][hit], "links": got[hit], "id": facts[1][hit], "to_id": facts[1][to], "to_node": facts[0][to]})

    found = left.unionByName(right).groupBy(*key).applyInArrow(work, OUT)
    # pairs of cells within the reach: every row of the one is linked with every row of the other
    weight = rows.groupBy("cell").agg(F.sum("n").alias("w"), F.min(F.struct("id", "node")).alias("low"))
    whole = pairs.where("whole")
    both = whole.select("a", "b").unionByName(whole.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(weight.select(F.col("cell").alias("b"), "w", "low"), "b")
    all_of = (rows.select(F.col("cell").alias("a"), "node", "id", "n").join(met, "a")
              .select("node", (F.col("w") - F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("links"), "id",
                      F.col("low.id").alias("to_id"), F.col("low.node").alias("to_node")))
    return found.unionByName(all_of)


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE,
                 cell: int = CELL) -> DataFrame:
    """One row per row of ``df``: id (null: ``NO_ID``), n_links, component (smallest id reachable)."""
    kind = "<f4" if isinstance(df.schema[embedding].dataType.elementType, FloatType) else "<f8"
    rows = vectors(df, vec_id, embedding, label)
    full = rows.where("key is not null")
    nodes = full.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("g").alias("g"), F.first("v").alias("v"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = cut(links(nodes.select("node", "id", "n", "g", "v"), kind, cosine, cell))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    name = F.struct("id", "node")
    edges = (found.select(name.alias("a"), F.struct(F.col("to_id").alias("id"), F.col("to_node").alias("node")).alias("b"))
             .where(F.col("a") != F.col("b")).distinct())
    ends = edges.select(F.col("a").alias("e")).union(edges.select("b")).distinct()
    roots = connected(ends, edges, [], "e").select(F.col("e.node").alias("node"), F.col("root.id").alias("component"))
    known = (nodes.select("key", "node", "id", "n").join(counts, "node", "left").join(roots, "node", "left")
             .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return full.select("id", "key").join(known, "key").select("id", "n_links", "component").unionByName(alone)


def digest(df: DataFrame, cell: int = CELL) -> DataFrame:
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return near_vectors(df, cell=cell).select(back("id").alias("vec_id"), "n_links", back("component").alias("component_id"),
                                              (F.col("id") == F.col("component")).alias("kept"))
