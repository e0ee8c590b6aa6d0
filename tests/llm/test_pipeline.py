"""Pipeline stages on the smallest tables: columns, rows kept, and effects."""

import hashlib

import corpus_pipeline
from boxlake.llm import decontaminate, near_dup

from .test_operators import near_by_force, repeats_by_force


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    known, single, cut, clean, packed = tables
    everything = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r.doc_id for r in known.collect()}
    assert all(not any(c.isalpha() for c in t) for i, t in everything.items() if i not in kept)
    roots = near_by_force([(i, everything[i]) for i in kept])
    assert {r.doc_id for r in single.collect()} == {root for _, root in roots.values()}
    want = repeats_by_force([(r.doc_id, r.text.encode()) for r in single.collect()])
    left = {r.doc_id: r for r in cut.collect()}
    assert set(left) == set(want)
    assert all(hashlib.sha256(left[i].text.encode()).hexdigest() == w[3] for i, w in want.items() if w[1] == 0)
    assert all(r.n_chars == len(r.text) and len(r.text.encode()) <= want[i][0] - want[i][1] for i, r in left.items())
    gone = set(left) - {r.doc_id for r in clean.collect()}
    found = {r.doc_id for r in decontaminate.find_leaks(cut, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert gone == found
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left) - gone
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
    assert near_dup.deduplicate(single).count() == single.count()


def test_near_duplicate_stage_takes_blocks_and_scattered_edits(spark):
    """A copy with 20% appended text (0.83 at three words, 0.83 at five) and a copy with 5 of 200 words changed
    (0.86 at three words, under 0.8 at five) go; half a copy stays."""
    word = lambda k: f"w{k}"
    block, spread, half = ([word(k + base) for k in range(200)] for base in (0, 1000, 2000))
    edited = [f"x{k}" if k in (20, 60, 100, 140, 180) else w for k, w in enumerate(spread)]
    texts = [block, block + [word(k) for k in range(5000, 5040)], spread, edited, half, half[:100] + [word(k) for k in range(6000, 6100)]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in near_dup.deduplicate(docs).collect()} == {0, 1, 2, 4, 5}
    assert {r.doc_id for r in near_dup.deduplicate(docs, rules=((5, 80),)).collect()} == {0, 2, 3, 4, 5}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {0, 2, 4, 5}


def test_banding_follows_the_threshold():
    assert near_dup.banding(85) == (32, 6)
    for percent in (50, 70, 80, 90):
        bands, rows = near_dup.banding(percent)
        assert bands * rows <= near_dup.COORDINATES and (1 - (percent / 100) ** rows) ** bands <= near_dup.MISS
