"""Exemplar search against the plain definition, at the default tile and over all scales."""

import tracemalloc

import numpy as np

from boxlake.operators import templates as tp


def plain(tile, tpl):
    h, w = tpl.shape
    t = tpl - tpl.mean()
    out = np.zeros((tile.shape[0] - h + 1, tile.shape[1] - w + 1))
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            a = tile[y:y + h, x:x + w]
            a = a - a.mean()
            den = np.sqrt((a * a).sum() * (t * t).sum())
            out[y, x] = (a * t).sum() / den if den > 1e-6 else 0
    return out


def test_correlation_equals_definition():
    r = np.random.default_rng(1)
    tile = r.integers(0, 256, (40, 52)).astype(float)
    tile[5:25, 10:30] = 7  # flat windows score 0
    for h, w in ((4, 4), (7, 5), (12, 9)):
        tpl = r.integers(0, 256, (h, w)).astype(float)
        assert np.allclose(tp.correlation(tile, tpl), plain(tile, tpl), atol=1e-9)


def test_memory_at_the_default_tile():
    r = np.random.default_rng(2)
    tile, tpl = r.integers(0, 256, (1024, 1024)).astype(float), r.integers(0, 256, (31, 31)).astype(float)
    tile[500:531, 700:731] = tpl
    tracemalloc.start()
    score = tp.correlation(tile, tpl)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.unravel_index(score.argmax(), score.shape) == (500, 700) and abs(score.max() - 1) < 1e-9
    assert peak < 16 * tile.nbytes


def test_match_job_over_all_scales(spark):
    r = np.random.default_rng(3)
    tpl = r.integers(50, 256, (12, 10)).astype(float)
    sheet = np.zeros((140, 160))
    places = {}
    for k, (w, h) in enumerate(tp.template_sizes(10, 12, (0.8, 0.9, 1.0, 1.1, 1.25))):
        y, x = 10 + 25 * k, 15 + 28 * k
        sheet[y:y + h, x:x + w] = tp.scale_template(tpl, w, h)
        places[(x, y)] = (w, h)
    ys, xs = np.nonzero(sheet)
    px = spark.createDataFrame([(0, int(x), int(y), float(sheet[y, x])) for y, x in zip(ys, xs)], "img long, x long, y long, v double")
    sizes = spark.createDataFrame([(0, 160, 140)], "img long, width long, height long")
    got = tp.match_exemplar(px, sizes, tpl, 0.95, tile=64, margin=4, to_base=2.0).collect()
    assert {(r.x, r.y): (r.w, r.h) for r in got} == {(2 * x, 2 * y): (2 * w, 2 * h) for (x, y), (w, h) in places.items()}
    few = tp.match_exemplar(px, sizes, tpl, 0.95, most=1, tile=64, margin=4)
    assert few.count() == 1


def test_registered_match_by_force(spark, sf_dir):
    """``r1_match_exemplar`` on all of ``v_pixel``: every scale at every place, cap, greedy suppression, map back."""
    import xxhash

    from boxlake.plans import load_all
    from boxlake.plans.registry import QUERIES, Views

    load_all()
    sheets = {}
    for r in Views(spark, sf_dir)("v_pixel").collect():
        sheets.setdefault(r.img, {})[r.y, r.x] = r.v
    arrays = {}
    for img, own in sheets.items():
        arrays[img] = np.zeros((max(y for y, _ in own) + 1, max(x for _, x in own) + 1))
        for at, value in own.items():
            arrays[img][at] = value
    tpl, everything = arrays[3][33:41, 25:35], {}
    for img, a in arrays.items():
        found = []
        for w, h in sorted(set(tp.template_sizes(10, 8, (0.8, 0.9, 1.0, 1.1, 1.25)))):
            t = tp.scale_template(tpl, w, h)
            t = t - t.mean()
            win = np.lib.stride_tricks.sliding_window_view(a, (h, w))
            win = win - win.mean(axis=(2, 3), keepdims=True)
            den = np.sqrt((win * win).sum(axis=(2, 3)) * (t * t).sum())
            score = np.where(den > 1e-6, (win * t).sum(axis=(2, 3)) / np.where(den > 1e-6, den, 1), 0)
            found += [(-round(float(score[y, x]), 9), x, y, w, h) for y, x in zip(*(v.tolist() for v in np.nonzero(score >= 0.15)))]
        number = lambda f: int(np.uint64(xxhash.xxh64_intdigest(".".join(f"{k:09d}" for k in (f[2], f[1], f[4], f[3])), 42)).view(np.int64))
        found.sort(key=lambda f: (f[0], number(f)))
        everything[img] = found

    def greedy(most):
        want = set()
        for img, found in everything.items():
            kept = np.empty((0, 4))
            for s, x, y, w, h in found[:most]:
                iw = np.minimum(kept[:, 0] + kept[:, 2], x + w) - np.maximum(kept[:, 0], x)
                ih = np.minimum(kept[:, 1] + kept[:, 3], y + h) - np.maximum(kept[:, 1], y)
                inter = np.maximum(iw, 0) * np.maximum(ih, 0)
                if not (inter / (kept[:, 2] * kept[:, 3] + w * h - inter) > 0.3).any():
                    kept = np.vstack([kept, (x, y, w, h)])
                    want.add((img, 2 * x, 2 * y, 2 * w, 2 * h, -s))
        return want

    px = Views(spark, sf_dir)("v_pixel")
    sizes = spark.createDataFrame([(img, a.shape[1], a.shape[0]) for img, a in arrays.items()], "img long, width long, height long")
    few = tp.match_exemplar(px, sizes, tpl, 0.15, most=20, to_base=2.0)  # a cap that binds
    for rows, want in ((QUERIES["r1_match_exemplar"](spark, sf_dir), greedy(4000)), (few, greedy(20))):
        got = rows.collect()
        assert {(r.img, r.x, r.y, r.w, r.h) for r in got} == {x[:5] for x in want} and len(got) == len(want)
        assert np.allclose([r.score for r in sorted(got)], [x[5] for x in sorted(want)], atol=1e-8)
    assert any(len(found) > 20 for found in everything.values()), {k: len(v) for k, v in everything.items()}
    assert len({x[3:5] for x in greedy(4000)}) > 1


def test_flat_exemplar_finds_nothing_as_its_sql_says(spark, tmp_path):
    """On large tables nearly every pixel reaches the highest value; a flat exemplar correlates with nothing."""
    import duckdb

    from tests.duck import duck_rows, spark_rows

    duckdb.sql("""SELECT x AS l_partkey, y AS l_orderkey, img AS l_suppkey, CASE WHEN x = 100 AND y = 50 THEN 49.0 ELSE 50.0 END AS l_quantity
      FROM range(160) a(x), range(120) b(y), range(5) c(img)""").write_parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = spark_rows(spark, str(tmp_path), "r1_exemplar_search")
    assert got == duck_rows(con, "r1_exemplar_search") and not got[1]
