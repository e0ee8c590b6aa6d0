"""The manifest against a plain tree over lists."""

import hashlib
import zlib

import pytest

from boxlake.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    out = ""
    for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def levels_of(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([sha(*rows[-1][k:k + 3]) for k in range(0, len(rows[-1]), 3)])
    return rows


def by_force(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for s in sources:
        own = [(r["doc_id"] is None, r["doc_id"] or 0, leaf(r, r["text"]), r) for r in rows if r["source"] == s]
        own.sort(key=lambda x: x[:3])
        members[s] = own
        trees[s] = levels_of([x[2] for x in own])
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, own, r) in enumerate(members[s]):
            t, i = r["text"], r["doc_id"]
            if i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                t = t.replace("\n", "")
            d, proof = leaf(r, t), ""
            for tree, p in ((trees[s], at), (top, k)):
                for row in tree[:-1]:
                    first = p - p % 3
                    run = row[first:first + 3]
                    proof += "".join(x for n, x in enumerate(run) if n != p - first)
                    d = sha(*run[:p - first], d, *run[p - first + 1:])
                    p //= 3
            out.append((i, own, trees[s][-1][0], top[-1][0], sha(proof), d, d == top[-1][0]))
    return sorted(out, key=str)


def check(docs, **how):
    got = merkle.digest(docs, **how)
    assert got.columns == COLUMNS
    rows = [r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_force(rows)
    return got


def test_given_documents(spark, sf_dir):
    got = check(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert any(r.verified for r in got) and any(not r.verified for r in got)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (3, 1, 4, 9, 2), (730, 1, 27, 28), (2200,)])
def test_shapes(spark, sizes):
    """One leaf, runs that are not full, blocks that hold one node, several levels of blocks."""
    rows = [(n * 10_000 + k, f"text {k}\nmore", "en", None if n == 2 else f"s{n}", k) for n, size in enumerate(sizes) for k in range(size)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_small_blocks_climb_several_times(spark):
    rows = [(k, f"t{k}\n", "en", "a" if k % 3 else f"b{k}", 1) for k in range(70)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), levels=1)


def test_awkward_rows(awkward, nothing):
    check(awkward.withColumn("tree", awkward["id"]).withColumn("leaf", awkward["key"]))
    assert merkle.digest(nothing).collect() == []


def test_versions_share_what_they_do_not_change():
    tree = merkle.Versions([sha(str(k)) for k in range(100)], merkle.height(100))
    before, count = list(tree.digests), len(tree.digests)
    other = tree.update(tree.root, 42, sha("x"))
    assert tree.digests[:count] == before and len(tree.digests) == count + 1 + merkle.height(100)
    assert tree.digests[other] == merkle.Versions([sha("x" if k == 42 else str(k)) for k in range(100)], 5).digests[-1]
    assert merkle.fold(sha("x"), tree.way_up(42)) == tree.digests[other]
