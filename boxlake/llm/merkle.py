"""Merkle manifest of a table of documents, with a proof and a tamper check per row.

A document's leaf is the digest of its columns. Leaves of one source in order of id are the first row of a tree
whose nodes take ``FAN`` consecutive nodes each; the roots of all sources in order make the first row of one more
tree, whose root names the whole table.

Trees are cut into aligned blocks of ``FAN ** levels`` nodes. A block is small enough for one task whatever its
source holds, so each level of blocks is one distributed pass (``climb``): blocks give their roots to the pass
above and get back the way up, as the siblings of every level. Inside a block the tree is persistent: nodes are
never changed, a tampered leaf makes a version of its own that copies the leaf's ancestors and shares all other
nodes (``Versions``). Such a version goes on above its block by copying one node per level of the way up, next to
siblings that all versions share; nobody gathers the versions of several blocks.

Defined results: ids, sources and texts may be null; a null source is a source of its own and comes first, a null
id comes last and is never tampered with. Rows of equal id are ordered by leaf, so repeated rows differ in their
proofs alone. A very long text costs one digest of its bytes. Extra columns are ignored. An empty table gives an
empty result, a table of one row the leaf as its root and the digest of nothing as its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.operators.ranking import exact_rank
from boxlake.session import cut

#: nodes under one node; levels of a block
FAN, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int, fan: int = FAN) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


class Versions:
    """Persistent tree of one block. A version is the number of its root; nodes are only ever added."""

    def __init__(self, leaves: list[str], levels: int):
        self.digests, self.children, self.levels = list(leaves), [()] * len(leaves), levels
        self.rows = [list(range(len(leaves)))]
        for _ in range(levels):
            row = self.rows[-1]
            self.rows.append([self._node(row[k:k + FAN]) for k in range(0, len(row), FAN)])
        self.root = self.rows[-1][0]

    def _node(self, kids: list[int]) -> int:
        self.digests.append(digest_of([self.digests[k] for k in kids]))
        self.children.append(tuple(kids))
        return len(self.digests) - 1

    def update(self, root: int, at: int, digest: str) -> int:
        """The version in which leaf ``at`` of version ``root`` has another digest; copies its ancestors only."""
        above, node = [], root
        for level in range(self.levels, 0, -1):
            nth = at // FAN ** (level - 1) % FAN
            above.append((node, nth))
            node = self.children[node][nth]
        self.digests.append(digest)
        self.children.append(())
        new = len(self.digests) - 1
        for node, nth in reversed(above):
            kids = list(self.children[node])
            kids[nth] = new
            new = self._node(kids)
        return new

    def way_up(self, at: int) -> list[tuple[str, str]]:
        """Per level the digests of the siblings before and after the leaf's ancestor, each as one text."""
        out = []
        for row in self.rows[:-1]:
            first = at - at % FAN
            run = [self.digests[k] for k in row[first:first + FAN]]
            out.append(("".join(run[:at - first]), "".join(run[at - first + 1:])))
            at //= FAN
        return out


def fold(digest: str, way: list[tuple[str, str]]) -> str:
    """The digest at the end of a way up."""
    for before, after in way:
        digest = digest_of([before, digest, after])
    return digest


def write_way(way: list[tuple[str, str]]) -> str:
    return "".join(f"{before}|{after}/" for before, after in way)


def read_way(way: str) -> list[tuple[str, str]]:
    return [tuple(level.split("|")) for level in way.split("/")[:-1]]


def leaf_of(columns: dict[str, Column]) -> Column:
    """Digest of the columns: ``-`` for a null, else size in bytes, colon, value."""
    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[field(columns[c]) for c in FIELDS]), 256)


def by_block(df: DataFrame, run: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``run`` to the rows of each (tree, block), in order of (kind, pos): a block's nodes and the way up. Blocks stream through sorted partitions, so that a million tiny trees are no million calls."""
    names = [f.split()[0] for f in schema.split(", ")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            if (row["tree"], row["block"]) != key:
                if held:
                    out += run(held)
                held, key = [], (row["tree"], row["block"])
                if len(out) >= 4000:
                    yield batch(out)
                    out = []
            held.append(row)
        if held:
            out += run(held)
        if out:
            yield batch(out)

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    keys = ["tree", "block"]
    return df.repartition(*keys).sortWithinPartitions(*keys, "kind", "pos").mapInArrow(blocks, schema)


def _levels(n: int, levels: int) -> int:
    """Levels that a block of a tree of ``n`` nodes has."""
    return min(levels, height(n))


def _roots(levels: int) -> Callable[[list[dict]], list[tuple]]:
    """One node of the row above the blocks for each block."""
    def roots(block: list[dict]) -> list[tuple]:
        r = block[0]
        tree = Versions([x["d"] for x in block], _levels(r["n"], levels))
        return [(r["tree"], -(-r["n"] // FAN ** levels), r["block"], tree.digests[tree.root])]
    return roots


NODES = "tree long, n long, pos long, d string"


def _block(pos: Column, levels: int) -> Column:
    return ((pos - pos % FAN ** levels) / FAN ** levels).cast("long").alias("block")


def climb(nodes: DataFrame, most: int, levels: int = LEVELS) -> DataFrame:
    """(tree, pos, way, top): the way from each node to the top of its tree. ``nodes``: (tree, n, pos, d) with n
    nodes in the tree at places 0 to n - 1; ``most``: the largest n."""
    if most <= 1:
        return nodes.select("tree", "pos", F.lit("").alias("way"), F.col("d").alias("top"))
    rows = nodes.select("tree", _block(F.col("pos"), levels), F.lit(1).alias("kind"), "pos", "n", "d")

    size = FAN ** levels
    above = climb(cut(by_block(rows, _roots(levels), NODES)), -(-most // size), levels)

    def ways(block: list[dict]) -> list[tuple]:
        up, nodes = block[0], block[1:]
        tree = Versions([x["d"] for x in nodes], _levels(nodes[0]["n"], levels))
        return [(x["tree"], x["pos"], write_way(tree.way_up(x["pos"] % size)) + up["way"], up["top"]) for x in nodes]

    none = F.lit(None).cast("string")
    both = (rows.select("*", none.alias("way"), none.alias("top"))
            .unionByName(above.select("tree", F.col("pos").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"),
                                      F.lit(0).cast("long").alias("n"), none.alias("d"), "way", "top")))
    return by_block(both, ways, "tree long, pos long, way string, top string")


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS, **columns: str) -> DataFrame:
    """One row per document row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``columns`` names the columns that stand for ``FIELDS``; ``levels`` is the height of a block; ``tampered`` is the text found at the check (default:
    as it was)."""
    own = {c: F.col(columns.get(c, c)) for c in FIELDS}
    found = own if tampered is None else {**own, "text": tampered}
    leaves = cut(docs.select(own["doc_id"].alias("doc_id"), own["source"].cast("string").alias("source"),
                             leaf_of(own).alias("leaf"), leaf_of(found).alias("found")))
    sizes = leaves.groupBy("source").agg(F.count("*").alias("n"))
    trees = cut(exact_rank(sizes, [], [F.col("source").asc_nulls_first()], "tree"))
    most = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    ranked = exact_rank(leaves, ["source"], [F.col("doc_id").asc_nulls_last(), F.col("leaf"), F.col("found")], "pos")
    of = trees.select(F.col("source").alias("s"), "tree", "n")
    placed = cut(ranked.join(of, ranked["source"].eqNullSafe(of["s"]))
                 .select("tree", "n", (F.col("pos") - 1).alias("pos"), _block(F.col("pos") - 1, levels),
                         "doc_id", F.col("leaf").alias("d"), "found"))

    blocks = cut(by_block(placed.withColumn("kind", F.lit(1)), _roots(levels), NODES))
    inner = cut(climb(blocks, -(-most[0] // FAN ** levels), levels))  # of each block to the root of its source
    subroots = inner.where("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.lit(most[1]).cast("long").alias("n"),
                                             (F.col("tree") - 1).alias("pos"), F.col("top").alias("d"))
    outer = climb(subroots, most[1], levels).select((F.col("pos") + 1).alias("tree"), F.col("way").alias("outer"), F.col("top").alias("root"))
    ways = inner.join(outer, "tree").select("tree", F.col("pos").alias("block"), F.concat("way", "outer").alias("way"), F.col("top").alias("subroot"), "root")

    def prove(block: list[dict]) -> list[tuple]:
        up, rows = block[0], block[1:]
        tree = Versions([x["d"] for x in rows], _levels(rows[0]["n"], levels))
        above, shared = read_way(up["way"]), up["way"].replace("|", "").replace("/", "")
        same, out = fold(tree.digests[tree.root], above), []
        for at, x in enumerate(rows):
            siblings = "".join(a + b for a, b in tree.way_up(at)) + shared
            end = same
            if x["found"] != x["d"]:
                end = fold(tree.digests[tree.update(tree.root, at, x["found"])], above)
            out.append((x["doc_id"], x["d"], up["subroot"], up["root"], digest_of([siblings]), end, end == up["root"]))
        return out

    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    kind = docs.select(own["doc_id"].alias("i")).schema["i"].dataType.simpleString()
    text_id = placed.select("tree", "block", F.lit(1).alias("kind"), "pos", "n", F.col("doc_id").cast("string").alias("doc_id"), "d", "found",
                            none.alias("way"), none.alias("subroot"), none.alias("root"))
    both = text_id.unionByName(ways.select("tree", "block", F.lit(0).alias("kind"), zero.alias("pos"), zero.alias("n"), none.alias("doc_id"),
                                           none.alias("d"), none.alias("found"), "way", "subroot", "root"))
    out = by_block(both, prove, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def digest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every second document, by crc32 of its id, is found without its line breaks."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return manifest(docs, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), levels)
