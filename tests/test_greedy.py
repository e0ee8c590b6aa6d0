"""Rounds against the plain sequential greedy, on scenes full of ties and copies."""

import random

import pytest
from boxlake.operators.greedy import match_one_to_one, pick_peaks, suppress

BOX = "sheet_id long, {} long, x double, y double, w double, h double"


def overlap(a, b):
    iw = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    ih = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if iw <= 0 or ih <= 0:
        return 0.0
    return iw * ih / (a[2] * a[3] + b[2] * b[3] - iw * ih)


def sequential_nms(rows, thr):
    keep = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(overlap(r[2:6], k[2:6]) <= thr for k in keep):
            keep.append(r)
    return {r[1] for r in keep}


def sequential_match(preds, gts, thr):
    pairs = sorted(((overlap(p[2:6], g[2:6]), p[1], g[1]) for p in preds for g in gts), reverse=True)
    used_p, used_g, out = set(), set(), set()
    for v, p, g in pairs:
        if v >= thr and p not in used_p and g not in used_g:
            used_p.add(p)
            used_g.add(g)
            out.add((p, g))
    return out


def scenes(n_sheets, n, seed, grid):
    rnd = random.Random(seed)
    rows = []
    for s in range(n_sheets):
        for i in range(n):
            rows.append((s, s * 1000 + i, float(rnd.randrange(0, 120, grid)), float(rnd.randrange(0, 90, grid)),
                         float(rnd.choice([10, 20, 30])), float(rnd.choice([10, 20, 30])),
                         rnd.choice([0.1, 0.5, 0.5, 0.9])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("grid,frontier", [(1, 16), (5, 3), (30, 2)])
def test_suppress_equals_sequential(spark, grid, frontier):
    rows = scenes(12, 40, grid, grid)
    df = spark.createDataFrame(rows, BOX.format("pred_id") + ", score double")
    got = {r.pred_id for r in suppress(df, ["sheet_id"], 0.3, cell=32, frontier=frontier)
           .where("kept").collect()}
    want = set()
    for s in range(12):
        want |= sequential_nms([r for r in rows if r[0] == s], 0.3)
    assert got == want


def test_suppress_chain_threshold_and_flat_boxes(spark):
    rows = [(0, 1, 0., 0., 10., 10., .9), (0, 2, 4., 0., 10., 10., .8), (0, 3, 8., 0., 10., 10., .7),
            (0, 4, 50., 50., 0., 10., .1), (0, 5, 50., 50., 0., 10., .1),
            (1, 6, 0., 0., 10., 10., .5), (1, 7, 0., 0., 10., 10., .5),
            (2, 8, 0., 0., 10., 10., .9), (2, 9, 5., 0., 10., 10., .8)]
    df = spark.createDataFrame(rows, BOX.format("pred_id") + ", score double")
    got = {r.pred_id for r in suppress(df, ["sheet_id"], 0.3).where("kept").collect()}
    assert got == {1, 3, 4, 5, 6, 8}
    exact = suppress(df.where("sheet_id = 2"), ["sheet_id"], 1 / 3).where("kept").count()
    assert exact == 2, "IoU equal to the threshold stays"


@pytest.mark.parametrize("grid", [1, 5, 30, 60])
def test_match_equals_sequential(spark, grid):
    p = [r[:6] for r in scenes(10, 25, grid, grid)]
    g = [r[:6] for r in scenes(10, 18, grid + 100, grid)]
    got = {(r.pred_id, r.gt_id) for r in match_one_to_one(
        spark.createDataFrame(p, BOX.format("pred_id")), spark.createDataFrame(g, BOX.format("gt_id")),
        ["sheet_id"], 0.3, cell=32).collect()}
    want = set()
    for s in range(10):
        want |= sequential_match([r for r in p if r[0] == s], [r for r in g if r[0] == s], 0.3)
    assert got == want


def test_match_stack_of_copies(spark):
    """A hot spot: hundreds of copies on both sides pair off in id order in few rounds."""
    p = [(0, i, 10., 10., 20., 20.) for i in range(300)] + [(0, 900, 11., 10., 20., 20.)]
    g = [(0, i, 10., 10., 20., 20.) for i in range(200)]
    got = match_one_to_one(spark.createDataFrame(p, BOX.format("pred_id")),
                           spark.createDataFrame(g, BOX.format("gt_id")), ["sheet_id"], 0.5, max_rounds=5)
    assert {(r.pred_id, r.gt_id) for r in got.collect()} == {(299 - i, 199 - i) for i in range(200)}


def test_peaks_equal_sequential(spark):
    rnd = random.Random(3)
    cells = [(0, r * 40 + c, r, c, rnd.choice([.2, .7, .8, .9])) for r in range(30) for c in range(40)]
    df = spark.createDataFrame(cells, "tile long, cell_id long, row long, col long, score double")
    got = {r.cell_id for r in pick_peaks(df, ["tile"], 0.6, 2, 250).collect()}
    order = sorted((c for c in cells if c[4] >= .6), key=lambda c: (-c[4], c[1]))[:250]
    keep = []
    for c in order:
        if all(max(abs(c[2] - k[2]), abs(c[3] - k[3])) > 2 for k in keep):
            keep.append(c)
    assert got == {c[1] for c in keep}


def test_empty_inputs(spark):
    p = spark.createDataFrame([], BOX.format("pred_id") + ", score double")
    g = spark.createDataFrame([], BOX.format("gt_id"))
    assert suppress(p, ["sheet_id"]).count() == 0
    assert match_one_to_one(p.drop("score"), g, ["sheet_id"]).count() == 0


def test_suppress_small_boxes_beside_huge_ones(spark):
    """Thousands of disjoint small boxes under huge ones finish in a few rounds."""
    small = [(0, i, float(i % 100 * 30), float(i // 100 * 30), 20., 20., .5) for i in range(5000)]
    huge = [(0, 10_000 + i, float(i % 40), float(i // 40), 3000., 1600., .4 + i / 10_000) for i in range(1200)]
    df = spark.createDataFrame(small + huge, BOX.format("pred_id") + ", score double")
    got = {r.pred_id for r in suppress(df, ["sheet_id"], 0.3, max_rounds=12).where("kept").collect()}
    assert got == set(range(5000)) | {11_199}


@pytest.mark.parametrize("copies,left,right", [(300, 200, 180), (40, 300, 1), (1, 30, 40), (500, 100, 100)])
def test_match_copies_tied_to_two_stacks(spark, copies, left, right):
    """Copies that overlap two stacks equally pair off with both in id order, in a few rounds."""
    rnd = random.Random(copies)
    ids = rnd.sample(range(5000), left + right)
    p = [(0, i, 100., 10., 20., 20.) for i in rnd.sample(range(5000), copies)]
    g = [(0, i, 98., 10., 20., 20.) for i in ids[:left]] + [(0, i, 102., 10., 20., 20.) for i in ids[left:]]
    got = match_one_to_one(spark.createDataFrame(p, BOX.format("pred_id")), spark.createDataFrame(g, BOX.format("gt_id")),
                           ["sheet_id"], 0.5, max_rounds=4)
    assert {(r.pred_id, r.gt_id) for r in got.collect()} == sequential_match(p, g, 0.5)


def test_match_random_stacks(spark):
    """Stacks at few places: ties of every kind, copies on both sides."""
    rnd = random.Random(12)
    p = [(s, i, rnd.choice([0., 2., 4.]), rnd.choice([0., 2.]), 10., 10.) for s in range(4) for i in range(s * 100, s * 100 + 40)]
    g = [(s, i, rnd.choice([0., 2., 4., 6.]), rnd.choice([0., 2.]), 10., 10.) for s in range(4) for i in range(s * 100, s * 100 + 35)]
    got = {(r.pred_id, r.gt_id) for r in match_one_to_one(
        spark.createDataFrame(p, BOX.format("pred_id")), spark.createDataFrame(g, BOX.format("gt_id")), ["sheet_id"], 0.3).collect()}
    want = set()
    for s in range(4):
        want |= sequential_match([r for r in p if r[0] == s], [r for r in g if r[0] == s], 0.3)
    assert got == want


def test_suppression_below_five_hundredths(spark):
    """Boxes whose sides differ by more than 20 to 1 conflict at a low threshold, with and without a forced grid."""
    rows = [(1, 0, 0.0, 0.0, 401.0, 10.0, 0.9), (1, 1, 100.0, 0.0, 19.0, 10.0, 0.8), (1, 2, 900.0, 0.0, 19.0, 10.0, 0.7)]
    b = spark.createDataFrame(rows, "sheet_id long, pred_id long, x double, y double, w double, h double, score double")
    for cell in (None, 64):
        assert {r.pred_id for r in suppress(b, ["sheet_id"], thr=0.04, cell=cell).where("kept").collect()} == {0, 2}


@pytest.mark.parametrize("thr,crowd", [(0.3, 64), (0.3, 3), (0.5, 8), (0.02, 5)])
def test_suppress_crowded_cells_first(spark, thr, crowd):
    """Cells above ``crowd`` go through rounds, the others are compared at once: one result."""
    rows = [(*r[:4], r[4] + i % 7, r[5] + i % 3, None if i % 11 == 0 else r[6]) for i, r in enumerate(scenes(6, 60, 7, 3))]
    df = spark.createDataFrame(rows, BOX.format("pred_id") + ", score double")
    got = {r.pred_id for r in suppress(df, ["sheet_id"], thr, frontier=4, crowd=crowd).where("kept").collect()}
    want = set()
    for s in range(6):
        want |= sequential_nms([(*r[:6], -1.0 if r[6] is None else r[6]) for r in rows if r[0] == s], thr)
    assert got == want


@pytest.mark.parametrize("thr", [0.3, 0.5])
def test_suppress_shuffles_ids_in_rounds(spark, thr):
    """Three detections per object: boxes are dealt to their cells once, later rounds move ids only."""
    df = spark.range(0, 60_000, 1, 4).selectExpr(
        "id DIV 225 AS sheet_id", "id AS pred_id", "(id DIV 3) * 7919 % 1400 + id * 5 % 13 AS x", "(id DIV 3) * 104729 % 990 + id * 3 % 11 AS y",
        "18 + id * 31 % 14 AS w", "18 + id * 17 % 14 AS h", "(id * 7919 % 7501) / 7501D AS score")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert suppress(df, ["sheet_id"], thr).groupBy("kept").count().count() == 2
    assert (written() - before) / 60_000 < 260
