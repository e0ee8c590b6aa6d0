"""Embeddings, classifier scores, pixels, vector paths, documents and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.functions.numeric import round_exact_sql
from boxlake.operators import classifier as clf
from boxlake.operators import components as cc
from boxlake.operators import drawing as dr
from boxlake.operators import masks as mk
from boxlake.operators import raster as ra
from boxlake.operators import retrieval as ret
from boxlake.operators import templates as tp
from boxlake.plans.registry import query


def r4(c: str) -> str:
    return round_exact_sql(c, 4)


# --- embeddings ----------------------------------------------------------------------

# prototypes of capped or whole train rows, one long row per dimension, then as lists
PROTO = """td AS (SELECT label, i, avg(CAST(vec[i] AS DOUBLE)) AS m FROM (SELECT label, vec, unnest(range(1, len(vec) + 1)) AS i FROM v_emb WHERE split = 'train') GROUP BY label, i),
 tn AS (SELECT label, sqrt(sum(m * m)) + 1e-8 AS n FROM td GROUP BY label),
 proto AS (SELECT label, list(m / n ORDER BY i) AS p FROM td JOIN tn USING (label) GROUP BY label),
 val AS (SELECT id, label, CAST(vec AS DOUBLE[]) AS vec FROM v_emb WHERE split = 'val'),
 cost AS (SELECT v.id, v.label, p.label AS pl, round(list_dot_product(v.vec, p.p), 12) AS sim FROM val v, proto p),
 near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, pl) AS r FROM cost)"""
KS = "ks AS (SELECT unnest([1, 2, 5, 50]) AS k)"
CROP = """allv AS (SELECT id, label, CAST(vec AS DOUBLE[]) AS vec FROM {src}),
 pair AS (SELECT a.id, a.label, b.id AS gid, b.label AS gl, round(list_dot_product(a.vec, b.vec), 12) AS sim FROM allv a JOIN allv b ON a.id <> b.id),
 loo AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, gid) AS r FROM pair),
 sz AS (SELECT label, count(*) - 1 AS rel FROM allv GROUP BY label), tot AS (SELECT count(*) - 1 AS n FROM allv)"""


def long_metrics(kind: str, src: str, hit: str, n: str, rel: str) -> str:
    per = f"""(SELECT k, q.id, least(k, {n}) AS kk, rel, count(*) FILTER (r <= k AND {hit}) AS h FROM ks, {src} q JOIN {rel} USING (label) WHERE rel > 0 GROUP BY k, q.id, rel)"""
    wide = f"(SELECT k, avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg(h / kk) AS precision, avg(h / rel) AS recall FROM {per} GROUP BY k)"
    return f"SELECT '{kind}' AS kind, CAST(k AS BIGINT) AS k, metric, round(value, 9) AS value FROM (UNPIVOT {wide} ON accuracy, precision, recall INTO NAME metric VALUE value)"


def rounded(df, *cols, digits=9):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def split(v):
    e = v("v_emb").select("id", "label", "vec", "split")
    return e.where("split = 'train'").drop("split"), e.where("split = 'val'").drop("split")


def proto_rows(v):
    return ret.prototypes(split(v)[0])


@query("a16_prototypes", f"WITH {PROTO} SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(m / n, 9) AS value FROM td JOIN tn USING (label)", "v_emb")
def _(v):
    return proto_rows(v).select(F.col("label"), F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 9))


@query("j16_nearest_prototype", f"WITH {PROTO} SELECT id, CAST(label AS BIGINT) AS label, CAST(pl AS BIGINT) AS pred, round(sim, 9) AS sim FROM near WHERE r = 1", "v_emb")
def _(v):
    return rounded(ret.nearest_prototype(split(v)[1], proto_rows(v)), "sim")


@query("j17_nearest_crops", f"WITH {CROP.format(src='v_emb')} SELECT id AS qid, gid, round(sim, 9) AS sim, CAST(r AS INTEGER) AS rank FROM loo WHERE r <= 50", "v_emb")
def _(v):
    e = v("v_emb")
    return rounded(ret.nearest(e, e, 50, same_set=True).select("qid", "gid", "sim", "rank"), "sim")


_ARI = """cells AS (SELECT label, pred, count(*) AS n FROM assign GROUP BY ALL), s AS (SELECT (SELECT sum(n) FROM cells)::DOUBLE AS n, (SELECT sum(n * n) FROM cells)::DOUBLE AS c,
  (SELECT sum(m * m) FROM (SELECT sum(n) AS m FROM cells GROUP BY label))::DOUBLE AS a, (SELECT sum(m * m) FROM (SELECT sum(n) AS m FROM cells GROUP BY pred))::DOUBLE AS b),
 t AS (SELECT c - n AS tp, a - c AS fn, b - c AS fp, n * n - (a - c) - (b - c) - c AS tn FROM s)
 SELECT CASE WHEN fn = 0 AND fp = 0 THEN 1.0 ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari FROM t"""


@query("a17_prototype_ari", f"WITH {PROTO}, assign AS (SELECT id, label, pl AS pred FROM near WHERE r = 1), {_ARI}", "v_emb")
def _(v):
    return ret.adjusted_rand(ret.nearest_prototype(split(v)[1], proto_rows(v)))


@query("a17_rand_of_columns", f"WITH assign AS (SELECT event_type AS label, user_id % 7 AS pred FROM events), {_ARI}")
def _(v):
    return ret.adjusted_rand(v("events").select(F.col("event_type").alias("label"), (F.col("user_id") % 7).alias("pred")))


@query("a18_gallery_metrics", f"WITH {PROTO}, {KS}, pc AS (SELECT label, count(*) AS rel FROM proto GROUP BY label) "
       + long_metrics("proto", "near", "pl = q.label", "(SELECT count(*) FROM proto)", "pc"), "v_emb")
def _(v):
    g = proto_rows(v).select(F.col("label").alias("id"), "label", "vec")
    return rounded(ret.gallery_metrics(split(v)[1], g), "value")


@query("a18_crop_gallery", f"WITH {KS}, tr AS (SELECT * FROM v_emb WHERE split = 'train'), va AS (SELECT * FROM v_emb WHERE split = 'val'), "
       "c AS (SELECT a.id, a.label, b.label AS gl, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]), 12) DESC, b.id) AS r FROM va a, tr b),"
       " pc AS (SELECT label, count(*) AS rel FROM tr GROUP BY label) " + long_metrics("gallery", "c", "gl = q.label", "(SELECT count(*) FROM tr)", "pc"), "v_emb")
def _(v):
    tr, va = split(v)
    return rounded(ret.gallery_metrics(va, tr, kind="gallery"), "value")


@query("a19_crop_metrics", f"WITH {KS}, {CROP.format(src='v_emb')} " + long_metrics("crop", "loo", "gl = q.label", "(SELECT n FROM tot)", "sz"), "v_emb")
def _(v):
    return rounded(ret.crop_metrics(v("v_emb")), "value")


@query("a20_loo_accuracy", """WITH u AS (SELECT id, label, list_transform(vec::DOUBLE[], lambda x: x / (sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) + 1e-12)) AS vec FROM v_emb),
 p AS (SELECT a.id, a.label, b.label AS gl, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.vec, b.vec), 12) DESC, b.id) AS r FROM u a JOIN u b ON a.id <> b.id)
 SELECT avg(CASE WHEN label = gl THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM p WHERE r = 1""", "v_emb")
def _(v):
    return ret.loo_accuracy(v("v_emb"))


_CAPPED = PROTO.replace("FROM v_emb WHERE split = 'train')", "FROM capped)")
_BUNDLE = (f"WITH {KS}, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('0|', id)), id) AS cr FROM v_emb WHERE split = 'train') WHERE cr <= 64), {_CAPPED}, "
           + CROP.format(src="v_emb WHERE split = 'val'") + ", pc AS (SELECT label, count(*) AS rel FROM proto GROUP BY label), assign AS (SELECT id, label, pl AS pred FROM near WHERE r = 1), "
           + _ARI.replace("SELECT CASE WHEN fn", ", arit AS (SELECT CASE WHEN fn") + "), pm AS (" + long_metrics("proto", "near", "pl = q.label", "(SELECT count(*) FROM proto)", "pc")
           + "), cm AS (" + long_metrics("crop", "loo", "gl = q.label", "(SELECT n FROM tot)", "sz") + "), bundle AS (SELECT 'ari' AS kind, CAST(0 AS BIGINT) AS k, 'ari' AS metric, round(ari, 9) AS value FROM arit "
           "UNION ALL SELECT * FROM pm UNION ALL SELECT * FROM cm UNION ALL SELECT 'acc1', k, metric, value FROM pm WHERE k = 1 AND metric = 'accuracy')")


@query("a21_validation_bundle", _BUNDLE + " SELECT * FROM bundle", "v_emb")
def _(v):
    return rounded(ret.validation_bundle(*split(v)), "value")


@query("p34_flat_metrics", _BUNDLE + """ SELECT concat('val/', kind, '_', CASE metric WHEN 'accuracy' THEN 'acc' WHEN 'precision' THEN 'P' ELSE 'R' END, '@', k) AS key, value FROM bundle WHERE kind IN ('proto', 'crop')
 UNION ALL SELECT concat(CASE kind WHEN 'proto' THEN 'val/acc@' ELSE 'val/topk_acc@' END, k), value FROM bundle WHERE kind IN ('proto', 'crop') AND metric = 'accuracy' UNION ALL SELECT 'val/ari', value FROM bundle WHERE kind = 'ari'""", "v_emb")
def _(v):
    return rounded(ret.flat_metrics(ret.validation_bundle(*split(v))), "value")


@query("j15_similar_cells", """WITH u AS (SELECT id, label, list_transform(vec::DOUBLE[], lambda x: x / (sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) + 1e-6)) AS vec FROM v_emb),
 m AS (SELECT i, avg(vec[i]) AS m FROM (SELECT vec, unnest(range(1, len(vec) + 1)) AS i FROM u WHERE label = 0) GROUP BY i), n AS (SELECT sqrt(sum(m * m)) + 1e-6 AS n FROM m),
 t AS (SELECT list(m / n ORDER BY i) AS t FROM m, n) SELECT id, label, round(list_dot_product(vec, t), 9) AS sim FROM u, t WHERE list_dot_product(vec, t) >= 0.05""", "v_emb")
def _(v):
    return rounded(ret.similar_cells(v("v_emb"), F.col("label") == 0, 0.05).select("id", "label", "sim"), "sim")


@query("r3_layout")
def _(v):
    return ret.layout_2d(v("v_emb").select("id", "label", "vec")).select("id", "label", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("s10_embeddings", "SELECT id, label, len(vec) AS dim, round(list_dot_product(vec::DOUBLE[], vec::DOUBLE[]), 9) AS norm2 FROM v_emb", "v_emb")
def _(v):
    return v("v_emb").select("id", "label", F.size("vec").cast("bigint").alias("dim"), F.round(ret.dot(F.col("vec"), F.col("vec")), 9).alias("norm2"))


# --- classifier ----------------------------------------------------------------------

_PRF = f"""{r4('p')} AS precision, {r4('r')} AS recall, {r4('f')} AS f1"""


def prf_sql(src: str) -> str:
    return f"""pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS r FROM {src}),
 pf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pr)"""


@query("a12_prf_at", f"WITH c AS (SELECT count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn FROM v_scored), {prf_sql('c')} SELECT tp, fp, fn, {_PRF} FROM pf", "v_scored")
def _(v):
    return clf.prf_at(v("v_scored"))


_AUC = """WITH m AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0::DOUBLE AS rk FROM t)
 SELECT g AS scorer, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 12) AS auc FROM m GROUP BY g"""


@query("a13_roc_auc", "WITH t AS (SELECT 'all' AS g, y, score AS s FROM v_scored), " + _AUC[5:], "v_scored")
def _(v):
    return rounded(clf.roc_auc(v("v_scored").withColumn("scorer", F.lit("all")), ["scorer"]), "auc", digits=12)


@query("a13_roc_auc_detections", "WITH t AS (SELECT model AS g, CAST(name = '1-URGENT' AS INTEGER) AS y, score AS s FROM v_pred), " + _AUC[5:], "v_pred")
def _(v):
    p = v("v_pred").select(F.col("model").alias("scorer"), (F.col("name") == "1-URGENT").cast("int").alias("y"), "score")
    return rounded(clf.roc_auc(p, ["scorer"]), "auc", digits=12)


_BEST = f"""c AS (SELECT s.score, count(*) FILTER (x.score >= s.score AND y = 1) AS tp, count(*) FILTER (x.score >= s.score AND y = 0) AS fp, count(*) FILTER (x.score < s.score AND y = 1) AS fn
  FROM (SELECT DISTINCT score FROM sc) s, sc x GROUP BY s.score), {prf_sql('c')}, o AS (SELECT score, tp, fp, fn, {_PRF} FROM pf)
 SELECT {r4('score')} AS thr, tp, fp, fn, precision, recall, f1 FROM o ORDER BY f1 DESC, score LIMIT 1"""


@query("a14_best_f1", f"WITH sc AS (SELECT score, y FROM v_scored), {_BEST}", "v_scored")
def _(v):
    return clf.best_f1(v("v_scored"))


@query("a15_calibration", f"""WITH b AS (SELECT y, score, (SELECT CAST(sum(CASE WHEN score >= i * 0.1::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) FROM range(1, 10) e(i)) AS bin FROM v_scored),
 g AS (SELECT bin, count(*) AS n, avg(score) AS m, avg(y) AS p FROM b GROUP BY bin) SELECT bin, n, {round_exact_sql('m', 3)} AS mean_score, {round_exact_sql('p', 3)} AS frac_pos FROM g""", "v_scored")
def _(v):
    return clf.calibration(v("v_scored"))


@query("p31_calibrated", "SELECT id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-((score - 0.5::DOUBLE) * 8 / 1.7::DOUBLE))), 12) AS p FROM v_scored", "v_scored")
def _(v):
    return v("v_scored").select("id", F.round(clf.calibrated((F.col("score") - 0.5) * 8, 1.7), 12).alias("p"))


@query("p36_relabel", "SELECT id, CASE WHEN conf >= 0.5 THEN 1 ELSE 0 END AS label FROM v_scored", "v_scored")
def _(v):
    return clf.relabel(v("v_scored"), 0.5, "conf").select("id", "label")


@query("a35_label_flips", """SELECT count(*) AS n, count(*) FILTER (conf >= 0.5) AS pos, count(*) FILTER (conf < 0.5) AS neg, count(*) FILTER ((conf >= 0.5) <> (y = 1)) AS flips FROM v_scored""", "v_scored")
def _(v):
    return clf.label_flips(v("v_scored"), 0.5, "y", "conf")


@query("a36_shared_scores", "WITH t AS (SELECT 'score' AS g, y, score AS s FROM v_scored UNION ALL SELECT 'conf', y, conf FROM v_scored), " + _AUC[5:], "v_scored")
def _(v):
    return rounded(clf.roc_auc(clf.shared_scores(v("v_scored"), "y", ["score", "conf"]), ["scorer"]), "auc", digits=12)


@query("i5_temperature", """WITH RECURSIVE g AS (SELECT s.y, (s.score - 0.5::DOUBLE) * 8 + CASE WHEN s.y = 1 THEN 1.0::DOUBLE ELSE -1 END AS z FROM v_scored s),
 n AS (SELECT 0 AS k, 0.0::DOUBLE AS u UNION ALL
  SELECT k + 1, u - (SELECT greatest(-1.0, least(1.0, avg(-(p - y) * a) / avg((p - y) * a + p * (1 - p) * a * a)))
    FROM (SELECT y, z * exp(-u) AS a, 1 / (1 + exp(-z * exp(-u))) AS p FROM g)) FROM n WHERE k < 40)
 SELECT (SELECT count(*) FROM g) AS n, round(exp(u), 6) AS temperature FROM n WHERE k = 40""", "v_scored")
def _(v):
    """The fitted temperature."""
    z = (F.col("score") - 0.5) * 8 + F.when(F.col("y") == 1, 1.0).otherwise(-1.0)
    rows = v("v_scored").select("y", z.alias("logit"))
    return rows.agg(F.count("*").alias("n")).withColumn("temperature", F.round(F.lit(clf.fit_temperature(rows)), 6))


@query("r2_model_scores", "SELECT id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-((score * 2 - conf) / 1.5::DOUBLE))), 9) AS p FROM v_scored", "v_scored")
def _(v):
    def make_model():
        return lambda x: x[:, 0] * 2 - x[:, 1]

    return tp.score_candidates(v("v_scored"), make_model, ["score", "conf"], 1.5, out="p").select("id", F.round("p", 9).alias("p"))


# --- pixels --------------------------------------------------------------------------

BIN = "bin AS (SELECT img, x, y, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM v_pixel)"
PROFILE = f"""{BIN}, pr AS (SELECT img, 'row' AS axis, y AS pos, count(*) FILTER (v = 0) AS n FROM bin GROUP BY img, y UNION ALL SELECT img, 'col', x, count(*) FILTER (v = 0) FROM bin GROUP BY img, x),
 dense AS (SELECT s.img, s.axis, s.pos, coalesce(pr.n, 0) AS n FROM (SELECT img, axis, unnest(range(0, max(pos) + 1)) AS pos FROM pr GROUP BY img, axis) s LEFT JOIN pr USING (img, axis, pos)),
 st AS (SELECT img, axis, pos, abs(lead(n) OVER (PARTITION BY img, axis ORDER BY pos) - n) AS step FROM dense),
 lim AS (SELECT img, axis, CASE WHEN axis = 'row' THEN quantile_cont(step, {{row}}) ELSE quantile_cont(step, {{col}}) END AS l FROM st WHERE step IS NOT NULL GROUP BY img, axis),
 jumps AS (SELECT st.img, st.axis, pos, step FROM st JOIN lim USING (img, axis) WHERE step > l)"""


def binary(v):
    return v("v_pixel").withColumn("v", ra.binarize(F.col("v")))


@query("p35_binarize", "SELECT img, x, y, (v + v / 2.0::DOUBLE + v / 4.0::DOUBLE) / 3.0::DOUBLE AS g, CASE WHEN (v + v / 2.0::DOUBLE + v / 4.0::DOUBLE) / 3.0::DOUBLE > 127 THEN 255 ELSE 0 END AS b FROM v_pixel", "v_pixel")
def _(v):
    g = ra.gray(F.col("v"), F.col("v") / 2, F.col("v") / 4)
    return v("v_pixel").select("img", "x", "y", g.alias("g"), ra.binarize(g).alias("b"))


@query("a24_black_profiles", f"WITH {PROFILE} SELECT img, axis, pos, n FROM pr".format(row=0.939, col=0.992), "v_pixel")
def _(v):
    return ra.black_profiles(binary(v))


@query("w11_jumps", f"WITH {PROFILE} SELECT * FROM jumps".format(row=0.939, col=0.992), "v_pixel")
def _(v):
    return ra.find_jumps(ra.dense_profiles(ra.black_profiles(binary(v))))


SPLIT = """sp AS (SELECT img, width, coalesce((SELECT min(pos) FROM (SELECT j.img, pos, lag(pos) OVER (PARTITION BY j.img ORDER BY pos) AS p FROM jumps j WHERE axis = 'col') q WHERE q.img = s.img AND pos - p > 25), CAST(trunc(width * 0.22::DOUBLE) AS BIGINT)) AS split_x
 FROM (SELECT img, max(x) + 1 AS width FROM v_pixel GROUP BY img) s)"""


def split_x(v, row=93.9, col=90.0):
    sizes = v("v_pixel").groupBy("img").agg((F.max("x") + 1).alias("width"))
    return ra.split_column(ra.find_jumps(ra.dense_profiles(ra.black_profiles(binary(v))), row, col), sizes)


@query("w12_split_column", f"WITH {PROFILE}, {SPLIT} SELECT * FROM sp".replace("{{", "{").replace("}}", "}").format(row=0.939, col=0.9), "v_pixel")
def _(v):
    return split_x(v)


@query("w12_split_column_sparse", f"WITH {PROFILE}, {SPLIT} SELECT * FROM sp".replace("{{", "{").replace("}}", "}").format(row=0.939, col=0.992), "v_pixel")
def _(v):
    return split_x(v, col=99.2)


@query("a30_otsu", """WITH h AS (SELECT img, v, count(*) AS n FROM v_pixel GROUP BY ALL), c AS (SELECT img, v, sum(n) OVER w AS q, sum(n * v) OVER w AS s, sum(n) OVER (PARTITION BY img) AS qq, sum(n * v) OVER (PARTITION BY img) AS ss
  FROM h WINDOW w AS (PARTITION BY img ORDER BY v)), k AS (SELECT img, v, (q::DOUBLE / qq) * (1 - q::DOUBLE / qq) * (s::DOUBLE / q - (ss - s)::DOUBLE / (qq - q)) ** 2 AS var FROM c WHERE q < qq)
 SELECT img, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY var DESC, v) AS r FROM k) WHERE r = 1""", "v_pixel")
def _(v):
    return ra.otsu(v("v_pixel")).select("img", "threshold")


@query("a27_mask_stats", "SELECT img, v // 25 AS mask_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS pixels, avg(x) AS cx, avg(y) AS cy FROM v_pixel GROUP BY img, v // 25", "v_pixel")
def _(v):
    m = v("v_pixel").withColumn("mask_id", F.floor(F.col("v") / 25).cast("int"))
    return ra.mask_stats(m, ["img", "mask_id"])


@query("p30_mask_features", """SELECT img, mask_id, ((x1 - x0 + 1) * (y1 - y0 + 1))::DOUBLE / (160 * 120) AS norm_area, least(x1 - x0 + 1, y1 - y0 + 1)::DOUBLE / greatest(x1 - x0 + 1, y1 - y0 + 1) AS aspect,
 pixels::DOUBLE / ((x1 - x0 + 1) * (y1 - y0 + 1)) AS extent FROM (SELECT img, v // 25 AS mask_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS pixels FROM v_pixel GROUP BY img, v // 25)""", "v_pixel")
def _(v):
    m = v("v_pixel").withColumn("mask_id", F.floor(F.col("v") / 25).cast("int"))
    f = ra.mask_features(ra.mask_stats(m, ["img", "mask_id"]), F.lit(0.5), F.lit(160), F.lit(120))
    return f.select("img", "mask_id", "norm_area", "aspect", "extent")


@query("j23_ink_in_masks", """WITH m AS (SELECT img, v // 25 AS mask_id, x, y, v FROM v_pixel), b AS (SELECT img, mask_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) FILTER (v <= 127) AS ink FROM m GROUP BY ALL)
 SELECT img, mask_id, x, y, w, h, ink FROM b WHERE ink >= 40 AND ink::DOUBLE / (w * h) >= 0.01""", "v_pixel")
def _(v):
    px = v("v_pixel").withColumn("mask_id", F.floor(F.col("v") / 25).cast("int"))
    mask_runs = cc.ink_runs(px, ["img", "mask_id"]).drop("run")
    ink_runs = cc.ink_runs(v("v_pixel").where("v <= 127"), ["img"]).drop("run")
    return ra.ink_in_masks(mask_runs, ink_runs, 40, 0.01).select("img", "mask_id", "x", "y", "w", "h", F.col("ink"))


# every pixel lies in the masks of its gray band and of the band below, so masks overlap in pairs
def band_masks(v):
    px = v("v_pixel").select("img", "x", "y", F.explode(F.array(F.expr("v div 25"), F.expr("v div 25 - 1"))).alias("mask_id"))
    return mk.pack(cc.ink_runs(px, ["img", "mask_id"]).drop("run"), ["img", "mask_id"])


BANDS = "px AS (SELECT img, x, y, unnest([v // 25, v // 25 - 1]) AS mask_id FROM v_pixel)"


@query("a28_mask_algebra", f"""WITH {BANDS}, ids AS (SELECT DISTINCT img, mask_id FROM px), pair AS (SELECT a.img, a.mask_id, b.mask_id AS other FROM ids a JOIN ids b
  ON a.img = b.img AND b.mask_id IN (a.mask_id + 1, a.mask_id + 2)),
 u AS (SELECT p.img, p.mask_id, p.other, m.x, m.y, bool_or(m.mask_id = p.mask_id) AS a, bool_or(m.mask_id = p.other) AS b FROM pair p JOIN px m
   ON m.img = p.img AND m.mask_id IN (p.mask_id, p.other) GROUP BY ALL)
 SELECT img, mask_id, other, count(*) AS n_union, count_if(a AND b) AS n_common, count_if(a AND NOT b) AS n_only, min(x) AS ux0, min(y) AS uy0, max(x) AS ux1, max(y) AS uy1,
   min(CASE WHEN a AND b THEN x END) AS cx0, min(CASE WHEN a AND b THEN y END) AS cy0, max(CASE WHEN a AND NOT b THEN x END) AS ox1, max(CASE WHEN a AND NOT b THEN y END) AS oy1,
   count_if(a AND b)::DOUBLE / count(*) AS iou FROM u GROUP BY ALL""", "v_pixel")
def _(v):
    m = band_masks(v)
    a, b = F.col("mask"), F.col("with")
    near = m.select("img", F.col("mask_id").alias("other"), F.col("mask").alias("with"))
    lower = m.withColumn("other", F.explode(F.array(F.col("mask_id") + 1, F.col("mask_id") + 2)))
    pair = lower.join(near, ["img", "other"]).select(
        "img", "mask_id", "other", mk.union(a, b).alias("u"), mk.intersection(a, b).alias("c"), mk.difference(a, b).alias("o"), mk.mask_iou(a, b).alias("iou"))
    ends = pair.select("*", mk.extent(F.col("u")).alias("ue"), mk.extent(F.col("c")).alias("ce"), mk.extent(F.col("o")).alias("oe"))
    return ends.select("img", "mask_id", "other", mk.area(F.col("u")).alias("n_union"), mk.area(F.col("c")).alias("n_common"), mk.area(F.col("o")).alias("n_only"),
                       F.col("ue.x0").alias("ux0"), F.col("ue.y0").alias("uy0"), F.col("ue.x1").alias("ux1"), F.col("ue.y1").alias("uy1"),
                       F.col("ce.x0").alias("cx0"), F.col("ce.y0").alias("cy0"), F.col("oe.x1").alias("ox1"), F.col("oe.y1").alias("oy1"), "iou")


@query("a28_mask_choice", f"""WITH {BANDS}, size AS (SELECT img, mask_id, count(*) AS area, (mask_id * 7 + 3) % 10 / 10.0::DOUBLE AS score FROM px GROUP BY img, mask_id),
 hit AS (SELECT p.img, p.y * 160 + p.x AS pt_idx, s.* EXCLUDE (img), row_number() OVER (PARTITION BY p.img, p.x, p.y ORDER BY area, s.mask_id) - 1 AS i, count(*) OVER (PARTITION BY p.img, p.x, p.y) AS n
   FROM v_pixel p JOIN px m ON m.img = p.img AND m.x = p.x AND m.y = p.y JOIN size s ON s.img = m.img AND s.mask_id = m.mask_id WHERE area <= 0.5 * 160 * 120 AND (p.x + p.y) % 5 = 0),
 near AS (SELECT h.* FROM hit h JOIN hit o ON o.img = h.img AND o.pt_idx = h.pt_idx AND o.i = h.n // 2 WHERE h.area <= 1.1 * o.area),
 boxed AS (SELECT h.img, h.pt_idx, h.i, h.score, m.x, m.y, min(m.x) OVER w AS x0, max(m.x) OVER w AS x1, min(m.y) OVER w AS y0, max(m.y) OVER w AS y1, max(h.score) OVER w AS best
   FROM near h JOIN px m ON m.img = h.img AND m.mask_id = h.mask_id WINDOW w AS (PARTITION BY h.img, h.pt_idx)),
 kept AS (SELECT *, x1 - x0 > 158 OR y1 - y0 > 118 AS big FROM boxed WHERE i = 0 OR NOT (x1 - x0 > 158 OR y1 - y0 > 118))
 SELECT img, pt_idx, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, max(CASE WHEN big THEN score ELSE best END) AS score, count(DISTINCT y * 160 + x) AS pixels
 FROM kept GROUP BY img, pt_idx""", "v_pixel")
def _(v):
    m = band_masks(v).withColumn("score", (F.col("mask_id") * 7 + 3) % 10 / 10)
    pts = v("v_pixel").where((F.col("x") + F.col("y")) % 5 == 0).select("img", (F.col("y") * 160 + F.col("x")).alias("pt_idx"), "x", "y")
    got = mk.covering_masks(m, pts, ["img"], 160.0 * 120, 0.5, 1.1, 158)
    return got.select("img", "pt_idx", "x0", "y0", "x1", "y1", "score", mk.area(F.col("mask")).alias("pixels"))


@query("s12_hit_masks", f"""WITH {BANDS} SELECT img::VARCHAR AS scan_key, mask_id AS hit_id, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1,
 sum(x * 7 + y * 13) AS placed FROM px WHERE mask_id >= 3 GROUP BY ALL""", "v_pixel")
def _(v):
    """Masks of five scans written beside their hits, and read back for the hits at or above a score."""
    from boxlake.session import cut, scratch
    from boxlake.sources import writers as wr

    m = cut(band_masks(v).select(F.col("img").cast("string").alias("scan_key"), F.col("mask_id").alias("hit_id"), (F.col("mask_id") / 10).alias("score"), "mask"))
    path = scratch(v.spark, "hits")
    wr.write_hits(m.drop("mask"), path)
    wr.write_hit_masks(m, path)
    keys = sorted(r.scan_key for r in wr.finished_scans(v.spark, path).collect())
    hits = reduce(DataFrame.unionByName, [wr.read_hits(v.spark, path, k, 0.3) for k in keys])
    back = wr.read_hit_masks(v.spark, path, hits)
    placed = mk.unpack(back, ["scan_key", "hit_id"]).groupBy("scan_key", "hit_id").agg(F.sum(
        (F.col("xb") - F.col("xa") + 1) * (F.col("y") * 13 + (F.col("xa") + F.col("xb")) * 7 / 2)).cast("bigint").alias("placed"))
    return back.select("scan_key", "hit_id", mk.area(F.col("mask")).alias("pixels"), mk.extent(F.col("mask")).alias("e")).join(
        placed, ["scan_key", "hit_id"]).select("scan_key", "hit_id", "pixels", "e.x0", "e.y0", "e.x1", "e.y1", "placed")


def components(v, level=60):
    runs = cc.label_ink(v("v_pixel").where(F.col("v") <= level), ["img"])
    return cc.component_boxes(runs, ["img"])


COMPONENTS = """WITH RECURSIVE ink AS (SELECT img, y, x FROM v_pixel WHERE v <= 60), g AS (SELECT *, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS k FROM ink),
 run AS (SELECT img, y, min(x) AS xa, max(x) AS xb FROM g GROUP BY img, y, k),
 edge AS (SELECT a.img, a.y * 1000 + a.xa AS s, b.y * 1000 + b.xa AS t FROM run a JOIN run b ON a.img = b.img AND abs(a.y - b.y) = 1 AND a.xa - 1 <= b.xb AND b.xa - 1 <= a.xb),
 low(img, id, root) USING KEY (img, id) AS (SELECT img, y * 1000 + xa, y * 1000 + xa FROM run UNION
  SELECT e.img, e.t, min(l.root) FROM low l JOIN edge e ON e.img = l.img AND e.s = l.id JOIN recurring.low r ON r.img = e.img AND r.id = e.t WHERE l.root < r.root GROUP BY e.img, e.t),
 comp AS (SELECT r.img, root // 1000 AS root_y, root % 1000 AS root_x, min(xa) AS x, min(y) AS y, max(xb) - min(xa) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(sum(xb - xa + 1) AS BIGINT) AS pixels
   FROM run r JOIN low l ON l.img = r.img AND l.id = r.y * 1000 + r.xa GROUP BY r.img, root)"""


@query("i3_components", f"{COMPONENTS} SELECT * FROM comp", "v_pixel")
def _(v):
    return components(v)


@query("a23_component_boxes", f"{COMPONENTS} SELECT * FROM comp WHERE w >= 2 AND h >= 2 AND w <= 160 * 0.98::DOUBLE", "v_pixel")
def _(v):
    return cc.sizeable(components(v).withColumn("width", F.lit(160))).drop("width")


@query("i4_grow_from_seeds")
def _(v):
    comp = cc.compact(components(v), 160, 120, min_area=2)
    pts = v("v_pixel").where("v = 250").select("img", (F.col("y") * 160 + F.col("x")).alias("pt_idx"), "x", "y")
    return cc.grow_from_seeds(comp, pts, ["img"], search=6, gap=1, max_symbol=20)


def legend_rows(v, tol=6):
    comp = v("v_gt").select(F.col("sheet_id").alias("img"), F.col("gt_id").alias("label"), "x", "y", "w", "h")
    return ra.group_rows(comp, tol)


FOLD = """c AS (SELECT sheet_id AS img, gt_id, x, y, w, h, y + h / 2.0::DOUBLE AS cy FROM v_gt), o AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY cy, gt_id) AS i FROM c),
 walk AS (SELECT img, gt_id, i, cy AS s, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS row FROM o WHERE i = 1 UNION ALL
  SELECT o.img, o.gt_id, o.i, CASE WHEN abs(o.cy - s / n) < 6 THEN s + o.cy ELSE o.cy END, CASE WHEN abs(o.cy - s / n) < 6 THEN n + 1 ELSE 1 END, CASE WHEN abs(o.cy - s / n) < 6 THEN row ELSE row + 1 END
  FROM walk k JOIN o ON o.img = k.img AND o.i = k.i + 1)"""


@query("w13_group_rows", f"WITH RECURSIVE {FOLD} SELECT img, gt_id AS label, row FROM walk", "v_gt")
def _(v):
    return legend_rows(v).select("img", "label", "row")


@query("w14_legend", f"""WITH RECURSIVE {FOLD}, b AS (SELECT c.img, k.row, CASE WHEN c.x + c.w / 2.0::DOUBLE < 300 THEN 0 ELSE 1 END AS col, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h
   FROM walk k JOIN c ON c.gt_id = k.gt_id GROUP BY ALL), r AS (SELECT DISTINCT img, row FROM b),
 k AS (SELECT r.img, r.row, CASE WHEN t.img IS NOT NULL AND r.row % 4 <> 0 THEN concat('label ', r.row % 17) ELSE concat('Header_or_Section_Row_', r.row) END AS key,
   s.x AS sx, s.w AS sw, t.x AS tx, t.w AS tw FROM r LEFT JOIN b s ON s.img = r.img AND s.row = r.row AND s.col = 0 LEFT JOIN b t ON t.img = r.img AND t.row = r.row AND t.col = 1)
 SELECT img, key, row, sx, sw, tx, tw FROM (SELECT *, row_number() OVER (PARTITION BY img, key ORDER BY row DESC) AS i FROM k) WHERE i = 1""", "v_gt")
def _(v):
    rows = legend_rows(v)
    splits = rows.select("img").distinct().withColumn("split_x", F.lit(300))
    text = F.when(F.col("row") % 4 != 0, F.concat(F.lit("  label \t "), (F.col("row") % 17).cast("string"), F.lit(" "))).otherwise(F.lit("  "))
    texts = rows.select("img", "row").distinct().withColumn("text", text)
    leg = ra.legend(rows, splits, texts)
    return leg.select("img", "key", "row", F.col("symbol_box.x").alias("sx"), F.col("symbol_box.w").alias("sw"),
                      F.col("text_box.x").alias("tx"), F.col("text_box.w").alias("tw"))


@query("a22_shrink_wrap", "SELECT sheet_id, name, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM v_gt GROUP BY sheet_id, name", "v_gt")
def _(v):
    return ra.shrink_wrap(v("v_gt"), ["sheet_id", "name"])


@query("r1_exemplar_search", """WITH t AS (SELECT x - 40 AS dx, y - 30 AS dy, v::DOUBLE AS t FROM v_pixel WHERE img = 2 AND x BETWEEN 40 AND 45 AND y BETWEEN 30 AND 34),
 tpl AS (SELECT dx, dy, coalesce(t, 0.0) - (SELECT sum(t) FROM t) / 30 AS t FROM (SELECT unnest(range(0, 6)) AS dx) JOIN (SELECT unnest(range(0, 5)) AS dy) ON true LEFT JOIN t USING (dx, dy)),
 size AS (SELECT img, max(x) + 1 AS width, max(y) + 1 AS height FROM v_pixel GROUP BY img),
 s AS (SELECT p.img, p.x - dx AS x, p.y - dy AS y, sum(p.v * t) AS num, sum(p.v)::DOUBLE AS s1, sum(p.v * p.v)::DOUBLE AS s2 FROM v_pixel p, tpl GROUP BY ALL),
 r AS (SELECT s.img, s.x, s.y, num / sqrt((s2 - s1 * s1 / 30) * (SELECT sum(t * t) FROM tpl)) AS score FROM s JOIN size z ON z.img = s.img WHERE x >= 0 AND y >= 0 AND x + 6 <= width AND y + 5 <= height AND sqrt(greatest(s2 - s1 * s1 / 30, 0) * (SELECT sum(t * t) FROM tpl)) > 1e-6)
 SELECT img, x, y, CAST(6 AS BIGINT) AS w, CAST(5 AS BIGINT) AS h, round(score, 6) AS score FROM r WHERE score >= 0.6""", "v_pixel")
def _(v):
    px = v("v_pixel")
    sizes = px.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    tpl = tp.exemplar(px, 2, 40, 30, 6, 5)
    return tp.search(px, sizes, tpl, 0.6, scales=(1.0,), tile=64, margin=4).withColumn("score", F.round("score", 6))


@query("r1_match_exemplar")
def _(v):
    """The whole job: default scales, tile, cap and suppression, boxes mapped back to a base of twice the size."""
    px = v("v_pixel")
    sizes = px.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return tp.match_exemplar(px, sizes, tp.exemplar(px, 3, 25, 33, 10, 8), 0.15, to_base=2.0)


# --- vector paths --------------------------------------------------------------------


def paths(v):
    p = v("v_path")
    g = F.array(F.col("gray"), F.col("gray"), F.col("gray"))
    vis = dr.visibility(F.col("type"), g, g, F.col("opacity"), F.col("opacity"))
    rect = F.when(F.col("path_id") % 11 == 0, F.lit(None)).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.col("rect_w"), F.col("rect_h")))
    return p.withColumn("visibility", vis).withColumn("rect", rect)


VIS = "vis AS (SELECT path_id, CAST(trunc((1 - (((0.0 + gray) + gray) + gray) / 3) * opacity * 255) AS INTEGER) AS visibility FROM v_path)"
THRESH = f"""{VIS}, lim AS (SELECT min(visibility)::DOUBLE AS lo, max(visibility)::DOUBLE AS hi FROM vis), g AS (SELECT visibility::DOUBLE AS v, least(floor((visibility - lo) / (hi - lo) * 256), 255) AS i, lo, (hi - lo) / 256 AS st FROM vis, lim),
 b AS (SELECT CAST(CASE WHEN v < i * st + lo THEN i - 1 WHEN i < 255 AND v >= (i + 1) * st + lo THEN i + 1 ELSE i END AS BIGINT) AS bin FROM g), h AS (SELECT k AS bin, count(b.bin) AS n FROM range(-1, 257) t(k) LEFT JOIN b ON b.bin = k GROUP BY k),
 ch AS (SELECT bin, n, CASE WHEN n = lag(n) OVER (ORDER BY bin) THEN 0 ELSE 1 END AS c FROM h), ru AS (SELECT min(bin) AS a, max(bin) AS z, max(n) AS n FROM (SELECT *, sum(c) OVER (ORDER BY bin) AS r FROM ch) GROUP BY r),
 pk AS (SELECT CAST(floor((a + z) / 2) AS BIGINT) AS bin, n FROM (SELECT *, lag(n) OVER (ORDER BY a) AS p, lead(n) OVER (ORDER BY a) AS q FROM ru) WHERE n > p AND n > q),
 th AS (SELECT trunc(sum((CASE WHEN bin = 255 THEN hi ELSE (bin + 1) * ((hi - lo) / 256) + lo END) * n) / sum(n)) AS threshold FROM pk, lim)"""


@query("p27_visibility", f"WITH {VIS} SELECT * FROM vis", "v_path")
def _(v):
    return paths(v).select("path_id", "visibility")


@query("p28_drop_long", "SELECT path_id FROM v_path WHERE path_id % 11 = 0 OR (rect_w <= 100 AND rect_h <= 100)", "v_path")
def _(v):
    return dr.drop_long(paths(v), 100).select("path_id")


@query("a25_visible_paths", f"WITH {THRESH} SELECT path_id, visibility, threshold FROM vis, th WHERE visibility >= threshold", "v_path")
def _(v):
    p = paths(v)
    return dr.visible_paths(p).select("path_id", "visibility").withColumn("threshold", dr.visibility_threshold(p).scalar())


STYLE = ("type", "dashes", "line_cap", "opacity", "note")


def styled(v):
    return v("v_path").withColumn("note", F.when(F.col("kind") != "c", F.col("kind")))


GRP = """p AS (SELECT *, CASE WHEN kind <> 'c' THEN kind END AS note FROM v_path), g AS (SELECT type, dashes, line_cap, opacity, note, count(*) AS n_paths, min(path_id) AS first_path, row_number() OVER (ORDER BY min(path_id)) - 1 AS grp FROM p GROUP BY ALL)"""


@query("a26_style_groups", f"WITH {GRP} SELECT * FROM g", "v_path")
def _(v):
    return dr.style_groups(styled(v), STYLE)


@query("a26_grouped_paths", f"WITH {GRP} SELECT path_id, grp, row_number() OVER (PARTITION BY grp ORDER BY path_id) - 1 AS pos FROM p JOIN g ON p.type = g.type AND p.dashes = g.dashes AND p.line_cap = g.line_cap AND p.opacity = g.opacity AND p.note IS NOT DISTINCT FROM g.note", "v_path")
def _(v):
    return dr.grouped_paths(styled(v), STYLE).select("path_id", "grp", "pos")


@query("a31_shape_tallies", """SELECT CASE kind WHEN 'c' THEN 'curve' WHEN 'l' THEN 'line' ELSE 'rect' END AS shape, count(*) AS before, count(*) FILTER (kind = 'c' OR greatest(rect_w, rect_h) <= 100) AS after FROM v_path GROUP BY kind""", "v_path")
def _(v):
    return dr.shape_tallies(v("v_path").withColumn("size", F.greatest("rect_w", "rect_h")), 100)
