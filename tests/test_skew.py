"""One key, class or spot holds a third of the rows or more; results stay whole."""

import random

from pyspark.sql import functions as F

from boxlake.operators import curation as cur
from boxlake.operators import detection as det
from boxlake.operators import retrieval as ret
from boxlake.operators import spatial as sp
from boxlake.operators.greedy import match_one_to_one, suppress
from tests.test_greedy import BOX, sequential_match, sequential_nms


def hot_scene(n_hot, n_rest, seed):
    """Near and exact copies stacked on one spot of sheet 0, the rest spread over five sheets."""
    rnd = random.Random(seed)
    hot = [(0, i, 100. + rnd.randrange(6), 100. + rnd.randrange(6), 20. + rnd.randrange(3), 20., rnd.choice([.5, .9])) for i in range(n_hot)]
    rest = [(1 + i % 5, 10_000 + i, float(rnd.randrange(800)), float(rnd.randrange(800)), 20., 20., rnd.random()) for i in range(n_rest)]
    return hot + rest


def test_suppress_hot_spot(spark):
    rows = hot_scene(1500, 1000, 1)
    df = spark.createDataFrame(rows, BOX.format("pred_id") + ", score double")
    got = {r.pred_id for r in suppress(df, ["sheet_id"], 0.3, max_rounds=60).where("kept").collect()}
    want = set()
    for s in range(6):
        want |= sequential_nms([r for r in rows if r[0] == s], 0.3)
    assert got == want


def test_match_hot_spot(spark):
    p = [r[:6] for r in hot_scene(150, 100, 2)]
    g = [r[:6] for r in hot_scene(60, 80, 3)]
    got = {(r.pred_id, r.gt_id) for r in match_one_to_one(
        spark.createDataFrame(p, BOX.format("pred_id")), spark.createDataFrame(g, BOX.format("gt_id")), ["sheet_id"], 0.5).collect()}
    want = set()
    for s in range(6):
        want |= sequential_match([r for r in p if r[0] == s], [r for r in g if r[0] == s], 0.5)
    assert got == want


def test_center_hits_on_copies(spark):
    """10 000 copies of a box over 10 000 copies of a point: 10^8 pairs if they were listed."""
    p = spark.range(10_000).selectExpr("0L AS sheet_id", "id AS pred_id", "0.0D AS x", "0.0D AS y", "10.0D AS w", "10.0D AS h")
    g = spark.range(10_000).selectExpr("0L AS sheet_id", "id AS gt_id", "5.0D AS px", "5.0D AS py")
    hb, hg = sp.flag_hits(p, g, ["sheet_id"])
    assert hb.where("hit").count() == hg.where("hit").count() == 10_000


def test_split_and_cap_hot_class(spark):
    rows = spark.range(6000).selectExpr("id", "concat('p', id) AS path", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('c', id % 40) END AS name")
    got = cur.stratified_split(rows).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "val").alias("v")).collect()
    assert sum(r.n for r in got) == 6000 and {r.name: r.v for r in got}["hot"] == 800
    pairs = cur.positive_pairs(rows.withColumnRenamed("name", "label"))
    assert pairs.count() == pairs.select("positive").distinct().count() == 6000
    assert pairs.where("anchor = positive").count() == 0


def test_neighbours_hot_label_and_copies(spark):
    df = spark.range(900).selectExpr("id", "CASE WHEN id % 3 < 2 THEN 0 ELSE id % 7 END AS label",
                                     "array(CASE WHEN id % 3 = 0 THEN 1.0D ELSE sin(id) END, 0.5D) AS vec")
    got = ret.nearest(df, df, 5, same_set=True, block_rows=100)
    assert got.count() == 4500 and got.where("qid = gid").count() == 0


def test_mining_hot_sheet(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 < 2 THEN 0L ELSE id % 10 END AS sheet_id", "id AS pred_id",
                                        "CASE WHEN id % 50 = 0 THEN 0.9D WHEN id % 4 = 0 THEN 0.05D ELSE 0.0D END AS iou",
                                        "CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS label")
    per = det.mine_negatives(rows, ["sheet_id"]).groupBy("sheet_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    have = {r.sheet_id: (r.p, r.n) for r in rows.groupBy("sheet_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()}
    assert {r.sheet_id: (r.p, r.n) for r in per} == {s: (p, min(n, 5 * p)) for s, (p, n) in have.items() if p}


def test_sheet_sized_boxes_cost_few_rows(spark):
    """A box of a whole sheet covers four cells of its own level; small boxes still meet it exactly once."""
    big = spark.createDataFrame([(0, 1, 0., 0., 28_000., 21_000.), (0, 2, 27_000., 20_000., 900., 900.)], "sheet_id long, id long, x double, y double, w double, h double")
    assert sp.cover_graded(big).groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    small = spark.range(2000).selectExpr("0L AS sheet_id", "id", "(id % 50) * 560.0D AS x", "floor(id / 50) * 525.0D AS y", "20.0D AS w", "20.0D AS h")
    pairs = sp.overlap_pairs(small, big, ["sheet_id"])
    rows = [(r.a_id, r.b_id) for r in pairs.select("a_id", "b_id").collect()]
    want = [(i, 1) for i in range(2000)] + [(i, 2) for i in range(2000) if 26_980 < i % 50 * 560 < 27_900 and 19_980 < i // 50 * 525 < 20_900]
    assert sorted(rows) == sorted(want)
    points = small.select("sheet_id", "id", F.col("x").alias("px"), F.col("y").alias("py"))
    assert sp.flag_hits(big, points, ["sheet_id"])[1].where("hit").count() == 2000


def test_retrieval_copies_of_boxes_over_one_point(spark):
    """100 000 near copies of a mask over one point are joined once per position."""
    masks = spark.range(100_000).selectExpr("0L AS sheet_id", "id AS mask_id", "10.0D + id % 3 AS x", "10.0D AS y", "20.0D AS w", "20.0D AS h", "0.5D AS score")
    points = spark.range(300).selectExpr("0L AS sheet_id", "id AS pt_idx", "20.0D AS x", "20.0D AS y")
    got = det.covering_choice(masks, points, ["sheet_id"], 1e6)
    assert got.count() == 300 and got.select("x0", "x1").distinct().count() == 1
