"""Mask columns against sets of pixels."""

import random

import pytest
from pyspark.sql import functions as F

from boxlake.operators import masks as mk
from boxlake.operators.components import ink_runs
from boxlake.sources import writers as wr


def table(spark, shapes):
    rows = [(k, x, y) for k, pixels in shapes.items() for x, y in pixels]
    return spark.createDataFrame(rows, "k long, x int, y int")


def packed(spark, shapes):
    return mk.pack(ink_runs(table(spark, shapes), ["k"]).drop("run"), ["k"])


def pixels(m):
    return {(x, m.y0 + i) for i, row in enumerate(m.rows) for r in row for x in range(r.xa, r.xb + 1)}


def shapes_of(seed):
    r = random.Random(seed)
    dense = {(r.randrange(12), r.randrange(9)) for _ in range(60)}
    holes = {(x, y) for x in range(10) for y in range(4, 20) if (x + y) % 3}
    far = {(x + 40, y + 40) for x, y in dense}
    bar = {(x, 5) for x in range(30)}
    return {0: dense, 1: holes, 2: far, 3: bar, 4: {(3, 3)}, 5: {(x, y) for x, y in bar | {(7, 15)}}, 6: {(-5, -3), (-4, -3), (6, 2)}}


@pytest.mark.parametrize("seed", [1, 2])
def test_algebra(spark, seed):
    shapes = shapes_of(seed)
    m = packed(spark, shapes)
    a, b = F.col("mask"), F.col("with")
    pair = m.join(m.select(F.col("k").alias("o"), F.col("mask").alias("with")))
    got = pair.select("k", "o", mk.union(a, b).alias("u"), mk.intersection(a, b).alias("c"), mk.difference(a, b).alias("d"),
                      mk.mask_iou(a, b).alias("iou"), mk.area(mk.union(a, b)).alias("n"), mk.extent(mk.intersection(a, b)).alias("e")).collect()
    assert len(got) == len(shapes) ** 2
    for r in got:
        x, y = shapes[r.k], shapes[r.o]
        assert (pixels(r.u), pixels(r.c), pixels(r.d), r.n) == (x | y, x & y, x - y, len(x | y))
        assert r.iou == len(x & y) / len(x | y)
        both = x & y
        want = (min(p[0] for p in both), min(p[1] for p in both), max(p[0] for p in both), max(p[1] for p in both)) if both else None
        assert (tuple(r.e) if r.e else None) == want
        for m in (r.u, r.c, r.d):  # normal form: full rows at both ends, runs apart and in order
            assert not m.rows or (m.rows[0] and m.rows[-1])
            assert all(s.xb + 1 < t.xa for row in m.rows for s, t in zip(row, row[1:], strict=False))


def test_empty_masks_and_membership(spark):
    m = packed(spark, {0: {(1, 1), (2, 1), (4, 3)}})
    a = F.col("mask")
    none = mk.difference(a, a)
    r = m.select(mk.area(none).alias("n"), mk.extent(none).alias("e"), mk.is_empty(none).alias("void"), mk.union(none, a).alias("u"),
                 mk.mask_iou(none, none).alias("iou"), mk.area(mk.intersection(none, a)).alias("c"),
                 F.array(*[mk.contains(a, F.lit(x), F.lit(y)) for x, y in ((1, 1), (3, 1), (4, 3), (4, 2), (0, 0), (4, 9))]).alias("at")).first()
    assert (r.n, r.e, r.void, r.iou, r.c) == (0, None, True, 0.0, 0) and pixels(r.u) == {(1, 1), (2, 1), (4, 3)}
    assert r["at"] == [True, False, True, False, False, False]


def test_union_by_is_the_union(spark):
    shapes = shapes_of(3)
    runs = mk.unpack(packed(spark, shapes), ["k"]).withColumn("g", F.col("k") % 2)
    got = {r.g: pixels(r.mask) for r in mk.pack(mk.union_by(runs.drop("k"), ["g"]), ["g"]).collect()}
    for g in (0, 1):
        assert got[g] == set().union(*[p for k, p in shapes.items() if k % 2 == g])


def test_store_keeps_masks(spark, tmp_path):
    shapes = shapes_of(4)
    m = packed(spark, shapes).select(F.concat(F.lit("0"), F.col("k") % 2).alias("scan_key"), F.col("k").alias("hit_id"), (F.col("k") / 10).alias("score"), "mask")
    blank = m.where("hit_id = 0").select("scan_key", F.lit(99).cast("long").alias("hit_id"), "score", mk.difference(F.col("mask"), F.col("mask")).alias("mask"))
    m, path = m.unionByName(blank), str(tmp_path / "hits")
    wr.write_hits(m.drop("mask"), path)
    wr.write_hit_masks(m, path)
    wr.write_hit_masks(m.where("scan_key = '00'"), path)  # again: replaces its own key alone
    for key in ("00", "01"):
        back = wr.read_hit_masks(spark, path, wr.read_hits(spark, path, key)).collect()
        assert {r.hit_id: pixels(r.mask) for r in back} == {
            **{k: p for k, p in shapes.items() if k % 2 == int(key)}, **({99: set()} if key == "00" else {})}


def test_covering_choice(spark):
    """Median of three, union, fall back, score and pixels."""
    square = lambda x, y, n: {(x + i, y + j) for i in range(n) for j in range(n)}
    shapes = {1: square(10, 10, 4), 2: square(11, 9, 4), 3: square(0, 0, 30), 4: square(60, 60, 5), 5: {(x, 62) for x in range(40, 66)}}
    m = packed(spark, shapes).withColumnRenamed("k", "mask_id").withColumn("score", F.col("mask_id") / 10).withColumn("sheet", F.lit(1))
    pts = spark.createDataFrame([(1, 0, 12, 11), (1, 1, 12, 11), (1, 2, 29, 29), (1, 3, 61, 62), (1, 4, 90, 90)], "sheet int, pt_idx int, x int, y int")
    got = {r.pt_idx: (r.x0, r.y0, r.x1, r.y1, r.score, pixels(r.mask)) for r in mk.covering_masks(m, pts, ["sheet"], 10_000.0, size_ratio=1.4, max_symbol=20).collect()}
    both = (10, 9, 14, 13, 0.2, shapes[1] | shapes[2])
    assert got == {0: both, 1: both, 2: (0, 0, 29, 29, 0.3, shapes[3]), 3: (60, 60, 64, 64, 0.4, shapes[4])}
