"""Boxes to points, against a plain search and by what the job moves."""

import random

from boxlake.operators import detection as det
from pyspark.sql import functions as F

BOX = "sheet_id long, pred_id long, x double, y double, w double, h double, score double, source string"


def test_boxes_to_points_equal_plain_search(spark):
    rnd = random.Random(5)
    boxes = [(i % 4, i, float(rnd.randrange(-900, 2500)), float(rnd.randrange(-400, 900)), float(rnd.choice([1, 20, 64, 65, 128, 700])),
              float(rnd.choice([1, 20, 64, 256, 300])), rnd.random(), rnd.choice(["none", "median"])) for i in range(400)]
    points = [(i % 3, i, float(rnd.randrange(0, 1400, 3)), float(rnd.randrange(0, 900, 3))) for i in range(150)]
    points += [(0, 900, 64., 64.), (0, 901, 64., 64.), (0, 902, 30_000., 0.)]
    boxes += [(0, 1000, 0., 0., 64., 64., .5, "none"), (0, 1001, 64., 64., 64., 64., .5, "none"), (0, 1002, None, 0., 1., 1., .5, "none")]

    def best(b):
        if b[2] is None:
            return None
        cx, cy = b[2] + b[4] / 2, b[3] + b[5] / 2
        inside = lambda p: b[2] <= p[2] <= b[2] + b[4] and b[3] <= p[3] <= b[3] + b[5]
        own = [(not inside(p), (p[2] - cx) ** 2 + (p[3] - cy) ** 2, p[1]) for p in points if p[0] == b[0]]
        return min(own)[2] if own else None

    want = {b[1]: best(b) for b in boxes if best(b) is not None}
    p = spark.createDataFrame(points, "sheet_id long, pt_idx long, x double, y double")
    own = det.boxes_to_points(spark.createDataFrame(boxes, BOX), p, ["sheet_id"], "pred_id").localCheckpoint()
    assert {r.pred_id: r.pt_idx for r in own.collect()} == want and own.count() == len(want)
    point = ["sheet_id", "pt_idx"]
    a, b = (det.one_box_per_point(own.where(F.col("source") == f), point) for f in ("none", "median"))
    got = det.tighter_per_point(own, point, "source", "none", "median")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, det.tighter_box(a, b, point).collect()))


def test_boxes_move_once(spark):
    """Most boxes hold a point; the bytes shuffled stay near one copy of the boxes and the points near them."""
    def table(name, shift):
        return spark.range(0, 60_000, 1, 4).selectExpr(
            "id DIV 225 AS sheet_id", f"id AS {name}", f"(id DIV 3) * 7919 % 1400 + id * 5 % 13 + IF(id % 5 = 0, {shift}, 0) AS x",
            "(id DIV 3) * 104729 % 990 + id * 3 % 11 AS y", "18 + id * 31 % 14 AS w", "18 + id * 17 % 14 AS h", "0.5D AS score", "'none' AS source")
    boxes = table("pred_id", 300)
    points = table("pt_idx", 0).where("pt_idx % 3 = 0").selectExpr("sheet_id", "pt_idx", "x + 12 AS x", "y + 12 AS y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
        before = written()
        assert det.boxes_to_points(boxes, points, ["sheet_id"], "pred_id").groupBy("source").count().first()[1] == 60_000
        moved = (written() - before) / 60_000
        assert moved < 160
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
