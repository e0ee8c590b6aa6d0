"""Components and region growing against flood fill."""

import random

from boxlake.operators import components as cc


def flood(ink):
    left, out = set(ink), []
    while left:
        todo = [left.pop()]
        comp = set(todo)
        while todo:
            y, x = todo.pop()
            for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if p in left:
                    left.remove(p)
                    comp.add(p)
                    todo.append(p)
        out.append(comp)
    return out


def box(comp):
    ys, xs = [p[0] for p in comp], [p[1] for p in comp]
    return min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(comp)


def image(seed, density, h=60, w=150):
    rnd = random.Random(seed)
    return {(y, x) for y in range(h) for x in range(w) if rnd.random() < density}


def test_components_equal_flood_fill(spark):
    images = {0: image(1, 0.12), 1: image(2, 0.35), 2: image(3, 0.45), 3: {(5, x) for x in range(140)} | {(y, 70) for y in range(60)}}
    # a spiral: one long thin component
    images[4] = {(0, i) for i in range(60)} | {(i, 59) for i in range(60)} | {(59, i) for i in range(60)} | {(i, 0) for i in range(2, 60)} | {(2, i) for i in range(58)}
    rows = [(k, p[0], p[1]) for k, ink in images.items() for p in ink]
    df = spark.createDataFrame(rows, "img long, y long, x long")
    got = sorted((r.img, r.x, r.y, r.w, r.h, r.pixels) for r in cc.component_boxes(cc.label_ink(df, ["img"]), ["img"]).collect())
    assert got == sorted((k, *box(c)) for k, ink in images.items() for c in flood(ink))


def test_component_filters(spark):
    c = spark.createDataFrame([(0, 1, 9, 9, 100), (1, 5, 5, 9, 100), (2, 99, 9, 99, 100), (3, 40, 3, 99, 100)], "id long, w long, h long, pixels long, width long")
    assert [r.id for r in cc.sizeable(c).collect()] == [1, 3]
    assert [r.id for r in cc.compact(c, 100, 100).collect()] == [1]


def test_growth_equals_plain_loop(spark):
    rnd = random.Random(8)
    comps = [(0, rnd.randrange(200), rnd.randrange(200), rnd.randrange(1, 12), rnd.randrange(1, 12)) for _ in range(250)]
    comps = list({c[:3]: c for c in comps}.values())
    pts = [(0, i, rnd.randrange(200), rnd.randrange(200)) for i in range(40)]
    gap, search, lim = 1, 10, 30

    def dist2(c, p):
        dx = max(c[1] - p[2], p[2] - (c[1] + c[3] - 1), 0)
        dy = max(c[2] - p[3], p[3] - (c[2] + c[4] - 1), 0)
        return dx * dx + dy * dy

    want = {}
    for p in pts:
        near = [c for c in comps if dist2(c, p) <= search * search]
        if not near:
            continue
        s = min(near, key=lambda c: (dist2(c, p), c[2], c[1]))
        x0, y0, x1, y1 = s[1], s[2], s[1] + s[3], s[2] + s[4]
        moved = True
        while moved:
            hit = [c for c in comps if c[1] <= x1 + gap and x0 <= c[1] + c[3] + gap and c[2] <= y1 + gap and y0 <= c[2] + c[4] + gap
                   and c[1] >= p[2] - lim and c[2] >= p[3] - lim and c[1] + c[3] - 1 <= p[2] + lim and c[2] + c[4] - 1 <= p[3] + lim]
            n = (min([x0] + [c[1] for c in hit]), min([y0] + [c[2] for c in hit]), max([x1] + [c[1] + c[3] for c in hit]), max([y1] + [c[2] + c[4] for c in hit]))
            moved = n != (x0, y0, x1, y1)
            x0, y0, x1, y1 = n
        want[p[1]] = (x0, y0, x1 - x0, y1 - y0)
    cdf = spark.createDataFrame([(c[0], c[2], c[1], c[1], c[2], c[3], c[4], c[3] * c[4]) for c in comps],
                                "img long, root_y long, root_x long, x long, y long, w long, h long, pixels long")
    pdf = spark.createDataFrame(pts, "img long, pt_idx long, x long, y long")
    got = {r.pt_idx: (r.x, r.y, r.w, r.h) for r in cc.grow_from_seeds(cdf, pdf, ["img"], search, gap, lim).collect()}
    assert got == want
