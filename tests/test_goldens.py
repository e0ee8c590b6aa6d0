"""Hand-written edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from boxlake.functions import geometry as geo
from boxlake.functions import text as tx
from boxlake.functions.geometry import Box
from boxlake.functions.numeric import round_exact
from boxlake.operators import classifier as clf
from boxlake.operators import curation as cur
from boxlake.operators import detection as det
from boxlake.operators import drawing as dr
from boxlake.operators import quality as q
from boxlake.operators import raster as ra
from boxlake.operators import retrieval as ret
from boxlake.operators import spatial as sp


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit_box(x, y, w, h):
    return Box(*[F.lit(float(v)) for v in (x, y, w, h)])


@pytest.mark.parametrize("a,b,want", [
    ((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 0, 10, 10), 0.0), ((0, 0, 10, 10), (10, 0, 10, 10), 0.0),
    ((0, 0, 10, 10), (2, 2, 5, 5), 0.25), ((0, 0, 0, 10), (0, 0, 10, 10), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou(spark, a, b, want):
    assert one(spark, v=geo.iou(lit_box(*a), lit_box(*b))).v == want


def test_round_exact_follows_binary_value(spark):
    vals = [1 / 160, 0.03125, 0.00005, 2.5e-5, 0.12345, 1.0, 0.0, 2 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(round_exact(F.col("v"), 4)).collect()]
    assert got == [round(v, 4) for v in vals]


def test_center_on_edge_counts(spark):
    p = spark.createDataFrame([(0, 1, 0., 0., 10., 10.)], "sheet_id long, pred_id long, x double, y double, w double, h double")
    g = spark.createDataFrame([(0, 1, 5., 5., 10., 10.), (0, 2, 6., 5., 10., 10.)], "sheet_id long, gt_id long, x double, y double, w double, h double")
    _, hits = sp.flag_hits(p, sp.with_center(g), ["sheet_id"])
    assert {r.gt_id: r.hit for r in hits.collect()} == {1: True, 2: False}


def test_tiles_small_image_and_seam(spark):
    small = spark.createDataFrame([(0, 100, 50)], "sheet_id long, width long, height long")
    assert [(r.x0, r.y0, r.x1, r.y1) for r in sp.tile_grid(small).collect()] == [(0, 0, 100, 50)]
    wide = spark.createDataFrame([(0, 200, 64)], "sheet_id long, width long, height long")
    tiles = sp.tile_grid(wide, 100, 20)
    assert sorted(r.x0 for r in tiles.collect()) == [0, 80, 100]
    pts = spark.createDataFrame([(0, 0, 90, 10), (0, 1, 500, 10)], "sheet_id long, pt_idx long, x long, y long")
    got = {r.pt_idx: r.tile for r in sp.assign_tiles(pts, tiles, ["sheet_id"], 100).collect()}
    assert got == {0: 0, 1: 0}  # margin 10 in tiles 0 and 1 alike: first wins; outside: tile 0


def test_tile_grid_covers_every_pixel(spark):
    s = spark.createDataFrame([(i, 150 + 37 * i, 90 + 53 * i) for i in range(6)], "sheet_id long, width long, height long")
    for grid in (sp.tile_grid(s, 70, 11), sp.tile_grid_clipped(s, 70, 11)):
        for i in range(6):
            seen = set()
            for r in grid.where(F.col("sheet_id") == i).collect():
                seen |= {(x, y) for x in range(r.x0, r.x1) for y in range(r.y0, r.y1)}
            assert len(seen) == (150 + 37 * i) * (90 + 53 * i)


def test_label_edges(spark):
    gt = spark.createDataFrame([(0, 1, 0., 0., 10., 10.)], "sheet_id long, gt_id long, x double, y double, w double, h double")
    # IoU exactly 0.5, exactly 0.1, 0, and a sheet without ground truth
    c = spark.createDataFrame([(0, 1, 0., 0., 10., 5.), (0, 2, 0., 0., 10., 1.), (0, 3, 50., 50., 10., 1.), (9, 4, 0., 0., 10., 10.)],
                              "sheet_id long, pred_id long, x double, y double, w double, h double")
    got = {r.pred_id: r.label for r in det.label_candidates(c, gt, ["sheet_id"]).collect()}
    assert got == {1: 1, 3: 0, 4: 0}


def test_no_positives_gives_nothing(spark):
    rows = spark.createDataFrame([(0, i, 0.01, 0) for i in range(5)], "sheet_id long, pred_id long, iou double, label int")
    assert det.mine_negatives(rows, ["sheet_id"]).count() == 0


def test_split_quotas(spark):
    rows = [(f"a{i}", "one") for i in range(1)] + [(f"b{i}", "two") for i in range(2)] + [(f"c{i}", "many") for i in range(25)]
    df = spark.createDataFrame(rows, "path string, name string")
    got = cur.stratified_split(df, 1, 0.1).groupBy("name").agg(F.count_if(F.col("split") == "val").alias("v")).collect()
    assert {r.name: r.v for r in got} == {"one": 0, "two": 1, "many": 2}


def test_holdout_needs_both_sides(spark):
    ids = spark.createDataFrame([("a",)], "rid string")
    with pytest.raises(Exception, match="no train ids"):
        cur.resolve_holdout(ids, ids).collect()
    both = cur.resolve_holdout(ids, ids, allow_empty=True)
    assert {r.split for r in both.collect()} == {"val"} and both.count() == ids.select("rid").distinct().count()


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(0, .5), (1, .5), (1, .5)], "y int, score double")
    assert clf.roc_auc(df).first().auc == 0.5
    assert math.isnan(clf.roc_auc(df.where("y = 1")).first().auc)
    neg = df.withColumn("score", F.col("y") * 0.3 + F.col("score"))
    a, b = clf.roc_auc(neg).first().auc, clf.roc_auc(neg.withColumn("score", -F.col("score"))).first().auc
    assert a == 1.0 and a + b == 1.0


def test_best_f1_empty_and_ties(spark):
    df = spark.createDataFrame([(1, .9), (1, .3), (0, .1)], "y int, score double")
    b = clf.best_f1(df).first()
    assert (b.thr, b.f1, b.tp) == (0.3, 1.0, 2)
    e = clf.best_f1(df.limit(0)).first()
    assert (e.thr, e.f1, e.tp) == (0.5, 0.0, 0)


def test_calibration_last_bin_closed(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.95), (0, 1.2), (1, 0.3)], "y int, score double")
    got = {r.bin: (r.n, r.frac_pos) for r in clf.calibration(df).collect()}
    edge = 3 if 0.3 >= 3 * 0.1 else 2
    assert got == {9: (2, 0.5), edge: (1, 1.0)}


def test_temperature_is_the_minimum(spark):
    import random

    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        z = rnd.gauss(0, 2)
        rows.append((1 if rnd.random() < 1 / (1 + math.exp(-z / 3)) else 0, z))
    t = clf.fit_temperature(spark.createDataFrame(rows, "y int, logit double"))

    def loss(temp):
        return sum(math.log1p(math.exp(-(2 * y - 1) * z / temp)) for y, z in rows)

    assert loss(t) <= min(loss(t * 0.99), loss(t * 1.01), loss(1.0))
    assert clf.fit_temperature(spark.createDataFrame([(1, 2.0)], "y int, logit double")) == 1.0


@pytest.mark.parametrize("pairs,want", [([(0, 0), (0, 0), (1, 1)], 1.0), ([(0, 0), (1, 0), (2, 0)], 0.0), ([(0, 0), (1, 1), (2, 2)], 1.0), ([], 0.0)])
def test_adjusted_rand(spark, pairs, want):
    assert ret.adjusted_rand(spark.createDataFrame(pairs, "label int, pred int")).first().ari == want


def test_blocks_do_not_change_neighbours(spark):
    import random

    rnd = random.Random(2)
    df = spark.createDataFrame([(i, i % 4, [rnd.choice([0., 1., 2.]) for _ in range(3)]) for i in range(60)], "id long, label int, vec array<double>")
    one_block = ret.nearest(df, df, 7, same_set=True).orderBy("qid", "rank").collect()
    many = ret.nearest(df, df, 7, same_set=True, block_rows=9).orderBy("qid", "rank").collect()
    assert one_block == many
    few = ret.nearest(df.limit(3), df.limit(3), 50, same_set=True)
    assert few.groupBy("qid").count().where("count != 2").count() == 0


def test_neighbours_leave_their_task_ranked(spark):
    """Copies and ties over several batches equal brute force; only the best k of a query leave its task, and nothing sorts them again."""
    import numpy as np

    rnd = np.random.default_rng(4)
    vecs = rnd.integers(-2, 3, (5000, 3)).astype(float)
    vecs[::3] = [1.0, 2.0, 2.0]
    df = spark.createDataFrame([(int(i), int(i % 4), v.tolist()) for i, v in enumerate(vecs)], "id long, label int, vec array<double>").repartition(3)
    out = ret.nearest(df, df, 7, same_set=True, block_rows=1300)
    got = {}
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.gid, r.sim))
    sims = vecs @ vecs.T
    for i in range(0, 5000, 50):
        want = sorted(((-sims[i, j], j) for j in range(5000) if j != i))[:7]
        assert got[i] == [(j, -s) for s, j in want]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(got) == 5000 and "Window" not in plan and plan.count("Exchange") == 3


def test_loo_accuracy_needs_two_rows(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0])], "id long, label int, vec array<double>")
    assert ret.loo_accuracy(df).first().accuracy == 0.0


def test_ring_rules(spark):
    def box(ring, fe=100, zoom=1.0):
        r = F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in ring])
        s = geo.axis_scale(F.lit(100), F.lit(fe))
        return one(spark, b=geo.ring_box(r, s, s, zoom)).b

    closed = [(0, 0), (10, 0), (10, -6), (0, 0)]
    assert tuple(box(closed)) == tuple(box(closed[:-1])) == (0, 0, 10, 6)
    assert box([(0, 0), (5, 5)]) is None
    assert box([(0, 0), (1, 0), (1, -9)]) is None
    assert tuple(box(closed, fe=0)) == (0, 0, 10, 6)
    assert tuple(box(closed, zoom=4.0)) == (0, 0, 40, 24)


def test_slugs(spark):
    vals = ["***", "  a b/c ", "x" * 90, "日本", None, "_a_", 'SUPPLY DUCT_22"X12"']
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(tx.slugify(F.col("v"))).collect()]
    assert got == ["_unnamed", "a_b_c", "x" * 80, "_unnamed", "_unnamed", "a", "SUPPLY_DUCT_22_X12"]


def test_space_and_labels(spark):
    vals = ["　a \t b\n", "bbox_ duct ", " bbox_", None]
    rows = spark.createDataFrame([(v,) for v in vals], "v string").select(tx.collapse_space(F.col("v")), tx.label_from_layer(F.col("v"))).collect()
    assert rows[0][0] == "a b" and [r[1] for r in rows[1:]] == ["duct", "_unnamed", "_unnamed"]


def test_vocabulary(spark):
    names = ["Duplex Receptacle", "door", None, "EXIT sign", "nlighter"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(tx.is_electrical(F.col("n"))).collect()]
    terms = {t.lower() for g in tx.ELECTRICAL_GROUPS.values() for t in g}
    assert got == [any(t in (n or "").lower() for t in terms) for n in names]
    assert one(spark, v=tx.electrical_vocabulary()).v and set(one(spark, v=tx.electrical_vocabulary()).v) == terms


def test_legend_fold_and_duplicate_keys(spark):
    # rows drift by 13: the running mean splits them
    rows = [(0, i, 100, 13 * i, 10, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "img long, label long, x long, y long, w long, h long")
    got = {r.label: r.row for r in ra.group_rows(df).collect()}
    cys, row, cur_row, want = [13 * i + 1 for i in range(5)], 0, [1], {0: 0}
    for i, cy in enumerate(cys[1:], 1):
        if abs(cy - sum(cur_row) / len(cur_row)) < 14:
            cur_row.append(cy)
        else:
            row, cur_row = row + 1, [cy]
        want[i] = row
    assert got == want
    texts = spark.createDataFrame([(0, r, "same") for r in range(5)], "img long, row long, text string")
    leg = ra.legend(ra.group_rows(df), spark.createDataFrame([(0, 50)], "img long, split_x long"), texts).collect()
    assert [(r.key, r.row) for r in leg] == [("same", max(want.values()))]


def test_visibility_rules(spark):
    flat = spark.createDataFrame([(i, 7) for i in range(5)], "path_id long, visibility int")
    assert dr.visible_paths(flat).count() == 5
    p = spark.createDataFrame([(0, None), (1, [0., 0., 50., 5.]), (2, [0., 0., 5., 5.])], "path_id long, rect array<double>")
    assert {r.path_id for r in dr.drop_long(p, 20).collect()} == {0, 2}


def test_visibility_threshold_matches_plain_histogram(spark):
    import random

    import numpy as np

    rnd = random.Random(4)
    vals = [rnd.choice([10, 10, 11, 60, 61, 200, 240, rnd.randrange(0, 255)]) for _ in range(700)]
    count, edges = np.histogram(vals, bins=256)
    pad = np.concatenate([[0], count, [0]])
    peaks, i = [], 1
    while i < len(pad) - 1:
        j = i
        while j + 1 < len(pad) and pad[j + 1] == pad[i]:
            j += 1
        if pad[i - 1] < pad[i] and j + 1 < len(pad) and pad[j + 1] < pad[i]:
            peaks.append((i + j) // 2)
        i = j + 1
    want = int(np.sum(edges[peaks] * pad[peaks]) / np.sum(pad[peaks]))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "path_id long, visibility int")
    assert dr.visibility_threshold(df).first().threshold == want


def test_sweep_grid_defaults(spark):
    got = [tuple(r) for r in det.sweep_grid(spark, " a ,,b", "", "").collect()]
    assert sorted(got) == [("bboxes", "a", "none"), ("bboxes", "b", "none")]


def test_fallback_keeps_a_box_with_one_fitting_side(spark):
    pts = spark.createDataFrame([(0, 1), (0, 2)], "sheet_id long, pt_idx long")
    model = spark.createDataFrame([], "sheet_id long, pt_idx long, x long, y long, w long, h long, score double, source string")
    comp = spark.createDataFrame([(0, 1, 0, 0, 100, 5, 20, 20), (0, 2, 0, 0, 100, 90, 20, 20)],
                                 "sheet_id long, pt_idx long, x long, y long, w long, h long, win_w long, win_h long")
    assert [(r.pt_idx, r.source) for r in det.with_fallback(pts, model, comp, ["sheet_id", "pt_idx"]).collect()] == [(1, "cc")]


def test_gate(spark):
    ok = spark.createDataFrame([(1, "a", True, "x")], "pos int, name string, ok boolean, detail string")
    bad = ok.withColumn("ok", F.lit(False))
    q.require_ok(ok)
    q.require_ok(None, skip=True)
    for report in (None, bad, ok.limit(0)):
        with pytest.raises(q.VerifyFailed):
            q.require_ok(report)


def test_missing_crops_end_the_report(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "rid string")
    pool = spark.createDataFrame([("a", "w", "p", "n", 4.0, "bbox_n")], "rid string, wid string, path string, name string, zoom double, layer string")
    side = ids.withColumn("split", F.lit("train"))
    rep = q.verify(ids, ids, pool, ids.where("rid = 'a'"), pool, pool.select("path", F.lit("train").alias("split")), side, ids, ids.select(F.lit("x").alias("split_mode")))
    assert [(r.pos, r.ok) for r in rep.orderBy("pos").collect()] == [(1, True), (2, False), (3, False)]


def test_early_stop_and_best(spark):
    h = spark.createDataFrame([("a", e, v) for e, v in enumerate([.1, .5, .5, .4, .3, .9, .9], 1)], "arm string, epoch long, ari double")
    assert cur.early_stop(h, patience=3).first().stop_epoch == 5
    b = cur.best_epochs(h).first()
    assert (b.first_best, b.last_best) == (6, 7)


def test_thinning(spark):
    import numpy as np

    df = spark.range(1000)
    for n in (1, 7, 100):
        assert sorted(r.id for r in cur.thin_evenly(df, n).collect()) == np.linspace(0, 999, n, dtype=int).tolist()
    assert cur.thin_evenly(spark.range(5), 10).count() == 5


def test_bucket_join_equals_nested_loop(spark):
    import random

    rnd = random.Random(9)
    a = [(0, i, float(rnd.randrange(-200, 900)), float(rnd.randrange(0, 500)), float(rnd.randrange(0, 300)), float(rnd.randrange(1, 200))) for i in range(120)]
    b = [(0, i, float(rnd.randrange(-200, 900)), float(rnd.randrange(0, 500)), float(rnd.randrange(1, 40)), float(rnd.randrange(1, 40))) for i in range(120)]
    schema = "sheet_id long, id long, x double, y double, w double, h double"
    got = {(r.a_id, r.b_id) for r in sp.overlap_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["sheet_id"]).collect()}
    want = {(p[1], g[1]) for p in a for g in b if min(p[2] + p[4], g[2] + g[4]) > max(p[2], g[2]) and min(p[3] + p[5], g[3] + g[5]) > max(p[3], g[3])}
    assert got == want
    assert sp.overlap_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["sheet_id"]).count() == len(want)


def test_nearest_distance_far_and_alone(spark):
    pts = [(0, 0, 0, 0), (0, 1, 100000, 3), (0, 2, 100000, 3), (0, 3, 5, 0), (1, 4, 7, 7), (2, 5, 0, 0), (2, 6, 90000, 0)]
    df = spark.createDataFrame(pts, "sheet_id long, pt_idx long, x long, y long")
    got = {r.pt_idx: r.nn for r in sp.nearest_distance(df, ["sheet_id"]).collect()}
    assert got == {0: 5.0, 1: 0.0, 2: 0.0, 3: 5.0, 4: None, 5: 90000.0, 6: 90000.0}
