"""Links of vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlake.llm import cover_tree

COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def by_force(rows, cosine=0.98):
    def direction(e):
        x = np.array([np.nan if v is None else v for v in e or [0]], float)
        if not np.isfinite(x).all() or not x.any():
            return None
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    x = [direction(r[1]) if r[2] is not None else None for r in rows]
    near = [[j for j, w in enumerate(x) if j != i and v is not None and w is not None and len(w) == len(v)
             and rows[i][2] == rows[j][2] and v @ w >= cosine] for i, v in enumerate(x)]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            seen |= dict.fromkeys(group, min(ids, default=None))
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def check(df, **how):
    got = cover_tree.digest(df, **how)
    assert got.columns == COLUMNS
    want = by_force([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    return want


def table(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in e], y) for i, e, y in rows], "vec_id long, embedding array<float>, label int")


def test_given_embeddings(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@pytest.mark.parametrize("cell", [2048, 40])
def test_groups_chains_and_copies(spark, cell):
    """Copies, a tight and a loose group, a chain whose ends differ, scattered vectors; small cells make upper levels."""
    r = np.random.default_rng(3)
    e, k = [], 0
    unit = lambda x: x / np.linalg.norm(x)
    e += [unit(r.normal(size=16)) for _ in range(150)]
    base = unit(r.normal(size=16))
    e += [base] * 30 + [2.5 * base] * 3
    e += [unit(base + 0.003 * r.normal(size=16)) for _ in range(120)]
    other = unit(r.normal(size=16))
    e += [unit(other + 0.035 * r.normal(size=16)) for _ in range(120)]
    walk = unit(r.normal(size=16))
    for _ in range(60):
        walk = unit(walk + 0.025 * r.normal(size=16))
        e.append(walk)
    order = r.permutation(len(e))
    rows = [(int(k), e[k], 1 if k % 11 else 2) for k in order]
    want = check(table(spark, rows), cell=cell)
    assert max(x[1] for x in want) > 100


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, 0), (2, [1.0, 0.001], 1, 0), (3, None, 1, 0), (4, [], 1, 0), (5, [0.0, 0.0], 1, 0), (6, [nan, 1.0], 1, 0),
            (7, [inf, 1.0], 1, 0), (8, [1.0, None], 1, 0), (9, [1.0, 0.0], None, 0), (10, [1.0, 0.0], None, 0), (11, [1.0, 0.0, 0.0], 1, 0),
            (12, [1.0, 0.0], 2, 0), (None, [1.0, 0.0], 1, 0), (None, [0.0, 1.0], 1, 0), (1, [0.0, 1.0], 1, 0), (1, [1.0, 0.0], 1, 0),
            (13, [1e300, 1e297], 1, 0), (14, [1e-300, 0.0], 1, 0), (15, [-1.0, 0.0], 1, 0), (16, [-0.0, 1.0], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int").withColumns({})
    check(df)
    assert cover_tree.digest(df.where("false")).collect() == []


def test_walk_drops_and_accepts_pairs_by_bounds():
    """Clusters far apart are never compared row by row, and a tight one is linked as a whole."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 8))
    x = np.concatenate([c + 0.001 * r.normal(size=(50, 8)) for c in centres])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    tree, order = cover_tree.grow(x)
    ones = np.ones(len(x), np.int64)
    walk = cover_tree.Walk(tree, None, ones, ones, 0.98)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert (walk.ga == want[order]).all()
    assert walk.visited < len(x) ** 2 / 20
    levels = [tree.radius[k] for k in tree.kids[:, 0][tree.kids[:, 1] > 0]]
    assert all(n < 2 for n in levels)
    for node in range(len(tree.lo)):  # the radius covers the rows, centres of children keep apart
        own = tree.x[tree.lo[node]:tree.hi[node]]
        assert cover_tree.distances(own, own[:1]).max() <= tree.radius[node] + 1e-7


def test_hubs_leave_few_levels(spark):
    """Vectors at all distances around one: the innermost centre is nearest to nearly all of them, level after level."""
    r = np.random.default_rng(5)
    e = r.normal(size=64)
    e = e / np.linalg.norm(e) + r.exponential(0.06, (600, 1)) * r.normal(size=(600, 64))
    df = table(spark, [(k, v, 1) for k, v in enumerate(e)])
    rows = cover_tree.vectors(df, "vec_id", "embedding", "label")
    nodes = rows.select(F.col("id").alias("node"), "id", F.lit(1).cast("long").alias("n"), "g", "v")
    done, tree, levels = cover_tree.cells(nodes, "<f4", 0.98, 40)
    assert levels <= 6
    assert len(str(done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 200  # digits: it fills the driver if levels multiply it
    assert done.count() == done.select("node").distinct().count() == 600
    assert tree.where("leaf").agg(F.sum("size")).first()[0] == 600
    want = check(df, cell=40)
    assert max(x[1] for x in want) > 100


def test_centre_amid_its_copies():
    """Rows that no level deals out are told apart by the ball of the hub; a tight cell and scattered rows need no hub."""
    r = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(r.normal(size=(1, 64)))
    ball = (cover_tree.reach(0.98) - cover_tree.SLACK) / 2
    centres, hub, beyond = cover_tree.spread(unit(base + r.exponential(0.06, (256, 1)) * r.normal(size=(256, 64))), 8, ball)
    assert len(centres) == 8 and hub >= 0 and beyond > 0.5
    for x in (unit(r.normal(size=(256, 64))), unit(base + 0.035 * r.normal(size=(256, 64)))):
        assert cover_tree.spread(x, 64, ball)[1] == -1
    centres, hub, beyond = cover_tree.spread(np.repeat(base, 256, axis=0), 8, ball)
    assert len(centres) == 8 and beyond == 0
