"""Classes, splits, samples, id sets, verification and training history."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlake.functions import text as tx
from boxlake.operators import curation as cur
from boxlake.operators import profile as prof
from boxlake.operators import quality as q
from boxlake.operators.retrieval import top_classes
from boxlake.plans.registry import query

KEEP = "keep AS (SELECT name, count(*) AS n FROM v_crop GROUP BY name HAVING count(*) >= 5)"
TRAIN_KEEP = "keep AS (SELECT name, count(*) AS n FROM v_crop WHERE split = 'train' GROUP BY name HAVING count(*) >= 5)"


def rids(v):
    return v("v_crop").select("rid", "split").distinct()


# --- classes -------------------------------------------------------------------------


@query("a1_class_counts", f"WITH {KEEP} SELECT * FROM keep", "v_crop")
def _(v):
    return cur.class_counts(v("v_crop"))


@query("w1_class_ids", f"WITH {KEEP} SELECT name, n, row_number() OVER (ORDER BY name) - 1 AS label FROM keep", "v_crop")
def _(v):
    return cur.class_ids(cur.class_counts(v("v_crop")))


@query("a3_class_summary", r"""SELECT name, CASE WHEN name IS NOT NULL THEN trim(regexp_replace(name, '[^a-zA-Z0-9._-]+', '_', 'g'), '_') END AS slug,
 CAST(sum(n) AS BIGINT) AS n_images, count(*) AS n_classes FROM (SELECT name, count(*) AS n FROM v_crop GROUP BY name) GROUP BY GROUPING SETS ((name), ())""", "v_crop")
def _(v):
    return cur.class_summary(v("v_crop"))


@query("a6_class_sizes", """SELECT count(*) AS n_classes, min(n) AS min_n, CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS median_n, max(n) AS max_n
 FROM (SELECT name, count(*) AS n FROM v_crop GROUP BY name)""", "v_crop")
def _(v):
    return cur.class_size_stats(v("v_crop"))


@query("a32_top_classes", """WITH t AS (SELECT label FROM v_emb GROUP BY label ORDER BY count(*) DESC, label LIMIT 4)
 SELECT id, label, label IN (SELECT label FROM t) AS top FROM v_emb""", "v_emb")
def _(v):
    return top_classes(v("v_emb").select("id", "label"), 4)


@query("a34_balance_weights", "SELECT id, y, 1.0::DOUBLE / count(*) OVER (PARTITION BY y) AS weight FROM v_scored", "v_scored")
def _(v):
    return cur.balance_weights(v("v_scored").select("id", "y"), "y")


@query("a34_balanced_resample", """WITH r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat('0|', id))) AS r FROM v_scored),
 s AS (SELECT y, count(*) AS n, row_number() OVER (ORDER BY y) AS c FROM v_scored GROUP BY y),
 d AS (SELECT i AS draw, CAST(concat('0x', substring(md5(concat('0|class|', i)), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS uc,
  CAST(concat('0x', substring(md5(concat('0|row|', i)), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS ur FROM range(0, 500) t(i)),
 p AS (SELECT draw, s.y, CAST(floor(ur * s.n) AS BIGINT) + 1 AS r FROM d JOIN s ON s.c = CAST(floor(uc * (SELECT count(*) FROM s)) AS BIGINT) + 1)
 SELECT draw, r.id, r.y FROM p JOIN r ON r.y = p.y AND r.r = p.r""", "v_scored")
def _(v):
    return cur.balanced_resample(v("v_scored").select("id", "y"), 500, 0, "y").select("draw", "id", "y")


# --- splits --------------------------------------------------------------------------


@query("w3_stratified_split", f"""WITH {KEEP}, ids AS (SELECT name, n, row_number() OVER (ORDER BY name) - 1 AS label FROM keep),
 r AS (SELECT c.path, c.name, k.label, k.n, row_number() OVER (PARTITION BY c.name ORDER BY md5(concat('0|', path))) AS r,
  greatest(1, round_even(k.n * 0.2::DOUBLE, 0)) AS q FROM v_crop c JOIN ids k USING (name))
 SELECT path, name, label, CASE WHEN n > 1 AND n - q >= 1 AND r <= q THEN 'val' ELSE 'train' END AS split FROM r""", "v_crop")
def _(v):
    return cur.stratified_split(v("v_crop")).select("path", "name", "label", "split")


@query("w4_sheet_split", """WITH s AS (SELECT u, row_number() OVER (ORDER BY md5(concat('0|', u))) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT concat(rid, '|', wid) AS u FROM v_crop))
 SELECT path, CASE WHEN r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM v_crop JOIN s ON u = concat(rid, '|', wid)""", "v_crop")
def _(v):
    return cur.sheet_split(v("v_crop"), fallback="path").select("path", "split")


@query("w4_single_sheet_split", """WITH s AS (SELECT path AS u, row_number() OVER (ORDER BY md5(concat('0|', path))) AS r, count(*) OVER () AS n FROM v_crop)
 SELECT u AS path, CASE WHEN r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM s""", "v_crop")
def _(v):
    one = v("v_crop").withColumn("rid", F.lit("r")).withColumn("wid", F.lit("w"))
    return cur.sheet_split(one, fallback="path").select("path", "split")


@query("w5_holdout_split", f"""WITH {TRAIN_KEEP}, ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS label FROM keep)
 SELECT path, rid, split, name, label FROM v_crop JOIN ids USING (name)""", "v_crop")
def _(v):
    return cur.holdout_split(v("v_crop"), rids(v)).select("path", "rid", "split", "name", "label")


@query("w6_ratio_split", """WITH s AS (SELECT wid, row_number() OVER (ORDER BY md5(concat('42|', wid))) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT wid FROM v_crop))
 SELECT path, CASE WHEN r <= greatest(1, round_even(n * (1 - 0.8::DOUBLE), 0)) THEN 'val' ELSE 'train' END AS split FROM v_crop JOIN s USING (wid)""", "v_crop")
def _(v):
    return cur.ratio_split(v("v_crop"), "wid").select("path", "split")


@query("a2_rid_counts", f"WITH {TRAIN_KEEP} SELECT rid, split, count(*) AS n FROM v_crop SEMI JOIN keep USING (name) GROUP BY rid, split", "v_crop")
def _(v):
    return cur.per_rid_counts(cur.holdout_split(v("v_crop"), rids(v)))


@query("a4_split_stats", f"""WITH {TRAIN_KEEP} SELECT count(*) FILTER (split = 'train' AND k) AS n_train, count(*) FILTER (split = 'val' AND k) AS n_val,
 (SELECT count(*) FROM keep) AS n_classes, count(*) FILTER (split = 'val' AND NOT k) AS n_val_dropped FROM (SELECT split, name IN (SELECT name FROM keep) AS k FROM v_crop)""", "v_crop")
def _(v):
    return cur.split_stats(v("v_crop"), rids(v))


@query("u5_dropped_val_classes", """WITH keep AS (SELECT name FROM v_crop WHERE split = 'train' GROUP BY name HAVING count(*) >= 40)
 SELECT DISTINCT name FROM v_crop WHERE split = 'val' EXCEPT SELECT name FROM keep""", "v_crop")
def _(v):
    return cur.dropped_val_classes(v("v_crop"), rids(v), 40)


@query("s13_split_tables", f"""WITH {TRAIN_KEEP}, ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS label FROM keep)
 SELECT 'member' AS kind, path AS key, split, label FROM v_crop JOIN ids USING (name) UNION ALL SELECT 'class', name, NULL, label FROM ids""", "v_crop")
def _(v):
    from boxlake.sources.writers import split_tables

    member, classes = split_tables(cur.holdout_split(v("v_crop"), rids(v)))
    return (member.select(F.lit("member").alias("kind"), F.col("path").alias("key"), "split", "label")
            .unionByName(classes.select(F.lit("class").alias("kind"), F.col("name").alias("key"), F.lit(None).cast("string").alias("split"), "label")))


@query("j5_split_members", f"""WITH {TRAIN_KEEP}, ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS label FROM keep)
 SELECT path, name, label FROM v_crop JOIN ids USING (name) WHERE split = 'val'""", "v_crop")
def _(v):
    crops = v("v_crop")
    classes = cur.class_ids(cur.class_counts(crops.where("split = 'train'")))
    return cur.split_members(crops.drop("split"), crops.select("path", "split"), classes, "val").select("path", "name", "label")


# --- samples -------------------------------------------------------------------------


@query("w7_cap_per_class", "SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('0|', id)), id) AS r FROM v_emb) WHERE r <= 30", "v_emb")
def _(v):
    return cur.cap_per_class(v("v_emb").select("id", "label"), 30)


@query("w9_sample_requests", "SELECT rid FROM (SELECT DISTINCT rid FROM v_crop) ORDER BY md5(concat('0|', rid)), rid LIMIT 5", "v_crop")
def _(v):
    return cur.sample_units(v("v_crop").select("rid").distinct(), 5)


@query("w9_sample_sheets", """SELECT rid, wid FROM (SELECT rid, wid, row_number() OVER (PARTITION BY rid ORDER BY md5(concat('0|', rid, '|', wid)), wid) AS r
 FROM (SELECT DISTINCT rid, wid FROM v_crop)) WHERE r <= 3""", "v_crop")
def _(v):
    return cur.sample_units(v("v_crop").select("rid", "wid").distinct(), 3, 0, ["rid"], "wid")


@query("w18_thin_evenly", """WITH r AS (SELECT id, label, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM v_emb),
 p AS (SELECT DISTINCT CASE WHEN i = 99 THEN (SELECT count(*) FROM v_emb) - 1 ELSE CAST(floor(i * ((SELECT count(*) FROM v_emb) - 1) / 99.0::DOUBLE) AS BIGINT) END AS r FROM range(0, 100) t(i))
 SELECT id, label FROM r SEMI JOIN p USING (r)""", "v_emb")
def _(v):
    return cur.thin_evenly(v("v_emb").select("id", "label"), 100)


@query("w18_draw_rows", "SELECT id, label FROM v_emb ORDER BY md5(concat('0|', id)), id LIMIT 100", "v_emb")
def _(v):
    return cur.draw_rows(v("v_emb").select("id", "label"), 100)


@query("j20_positive_pairs", """WITH r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY md5(concat('0|', id))) AS r, count(*) OVER (PARTITION BY label) AS n FROM v_emb)
 SELECT a.label, a.id AS anchor, b.id AS positive FROM r a JOIN r b ON a.label = b.label AND b.r = CASE WHEN a.r = a.n THEN 1 ELSE a.r + 1 END""", "v_emb")
def _(v):
    return cur.positive_pairs(v("v_emb"))


# --- id sets -------------------------------------------------------------------------


@query("u1_pool_manifests", """SELECT concat('/lake/', source, '/', lang, '/', doc_id, '.png') AS path, lang AS name, CAST(n_chars AS DOUBLE) AS score, NULL AS zoom FROM documents
 UNION ALL SELECT url, 'page', NULL, 4.0::DOUBLE FROM (SELECT concat('/pages/', page_id) AS url FROM pages)""")
def _(v):
    d = v("documents").select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
                              F.concat(F.lit("/lake/"), "source").alias("_base"), F.col("lang").alias("name"), F.col("n_chars").cast("double").alias("score"))
    p = v("pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string")).alias("path"),
                          F.lit("/unused").alias("_base"), F.lit("page").alias("name"), F.lit(4.0).alias("zoom"))
    return cur.pool_manifests([(d, F.col("_base")), (p, F.col("_base"))]).drop("_base")


@query("u2_train_then_val", "SELECT path, split FROM v_crop", "v_crop")
def _(v):
    return cur.both_splits(v("v_crop"), "all").select("path", "split")


@query("u3_overlap", """WITH c AS (SELECT lang, CASE WHEN source IN ('src3', 'src7') THEN 'val' ELSE 'train' END AS split FROM documents)
 SELECT lang FROM c WHERE split = 'train' INTERSECT SELECT lang FROM c WHERE split = 'val'""")
def _(v):
    split = F.when(F.col("source").isin("src3", "src7"), "val").otherwise("train")
    return cur.overlap(v("documents").select("lang", split.alias("split")), "lang")


@query("u4_val_wins", """WITH t AS (SELECT DISTINCT source AS rid FROM documents WHERE n_chars > 500), w AS (SELECT DISTINCT source AS rid FROM documents WHERE lang = 'fr' AND n_chars < 200)
 SELECT rid, 'train' AS split FROM t ANTI JOIN w USING (rid) UNION ALL SELECT rid, 'val' FROM w""")
def _(v):
    """Both lists come from the data here: on large tables every source is in val, and train is rightly empty."""
    d = v("documents")
    t = d.where("n_chars > 500").select(F.col("source").alias("rid"))
    w = d.where("lang = 'fr' AND n_chars < 200").select(F.col("source").alias("rid"))
    return cur.resolve_holdout(t, w, allow_empty=True)


@query("u7_extend_ids", """SELECT DISTINCT rid FROM v_crop WHERE split = 'train' UNION ALL SELECT unnest(['src3', 'src5']) AS rid EXCEPT ALL SELECT 'src5'""", "v_crop")
def _(v):
    have = v("v_crop").where("split = 'train'").select("rid").distinct()
    need = v("v_crop").where(F.col("rid").isin("src3", "src5")).select("rid").distinct()
    return cur.extend_ids(have, need)


@query("j3_sheets_with_features", """SELECT DISTINCT f.rid, f.wid FROM v_feature f SEMI JOIN (SELECT rid, wid FROM v_feature WHERE geometry_type = 3) USING (rid, wid)""", "v_feature")
def _(v):
    from boxlake.sources.readers import sheets_with_patches

    f = v("v_feature")
    return f.select("rid", "wid").distinct().join(sheets_with_patches(f.where("geometry_type = 3")), ["rid", "wid"], "left_semi")


@query("j4_missing_crops", """SELECT rid, rid IN (SELECT source FROM documents WHERE n_chars > 20000) AS has FROM (SELECT DISTINCT source AS rid FROM documents)""")
def _(v):
    ids = v("documents").select(F.col("source").alias("rid")).distinct()
    crops = v("documents").where("n_chars > 20000").select(F.col("source").alias("rid"))
    return (cur.with_crops(ids, crops).withColumn("has", F.lit(True))
            .unionByName(cur.without_crops(ids, crops).withColumn("has", F.lit(False))))


@query("w21_top_requests", """SELECT rid, count(DISTINCT wid) AS n_sheets FROM v_feature WHERE geometry_type = 3 GROUP BY rid ORDER BY 2 DESC, 1 LIMIT 10""", "v_feature")
def _(v):
    from boxlake.sources.readers import sheets_with_patches

    return cur.top_requests(sheets_with_patches(v("v_feature").where("geometry_type = 3")), 10)


@query("p11_manifest_filter", "SELECT path, rid, wid FROM v_crop WHERE split = 'train' AND starts_with(rid, 'src1') AND starts_with(wid, 'src1')", "v_crop")
def _(v):
    return cur.manifest_filter(v("v_crop"), "train", "src1", "src1").select("path", "rid", "wid")


# --- names and labels ----------------------------------------------------------------

SPACE_RE2 = tx.SPACE.replace("\\x0B", "\\v")


@query("p2_slugify", r"""SELECT page_id, CASE WHEN s = '' THEN '_unnamed' ELSE substring(s, 1, 80) END AS slug FROM (SELECT page_id,
 trim(regexp_replace(html, '[^a-zA-Z0-9._-]+', '_', 'g'), '_') AS s FROM pages)""")
def _(v):
    return v("pages").select("page_id", tx.slugify(F.col("html")).alias("slug"))


@query("p3_label_from_layer", """SELECT crop_id, regexp_replace(layer, '^bbox_', '') AS label FROM v_crop""", "v_crop")
def _(v):
    return v("v_crop").select("crop_id", tx.label_from_layer(F.col("layer")).alias("label"))


@query("p4_layer_filter", "SELECT crop_id FROM v_crop WHERE starts_with(CASE WHEN crop_id % 3 = 0 THEN name ELSE layer END, 'bbox_')", "v_crop")
def _(v):
    """Layers with the box prefix; every third crop's layer lost it."""
    layer = F.when(F.col("crop_id") % 3 == 0, F.col("name")).otherwise(F.col("layer"))
    return v("v_crop").where(layer.startswith(tx.LAYER_PREFIX)).select("crop_id")


@query("p8_electrical_filter", "SELECT doc_id, (" + " OR ".join(
    "contains(lower(text), '" + t + "')" for t in sorted({t.lower() for g in tx.ELECTRICAL_GROUPS.values() for t in g})) + ") AS hit FROM documents")
def _(v):
    return v("documents").select("doc_id", tx.is_electrical(F.col("text")).alias("hit"))


@query("u6_vocabulary", "SELECT term, count(*) AS n FROM (SELECT unnest([" + ", ".join("'" + t + "'" for t in sorted({t.lower() for g in tx.ELECTRICAL_GROUPS.values() for t in g}))
       + "]) AS term, lower(text) AS t FROM documents) WHERE contains(t, term) GROUP BY term")
def _(v):
    """How many texts hold each term of the joined vocabulary."""
    return tx.term_counts(v("documents"), "text", tx.electrical_terms())


@query("p9_wiring_filter", "SELECT doc_id, contains(lower(concat(lang, CASE WHEN n_chars % 3 = 0 THEN '_WIRING_DEVICES' ELSE '_LIGHTING' END)), 'wiring') AS keep FROM documents")
def _(v):
    cat = F.concat("lang", F.when(F.col("n_chars") % 3 == 0, "_WIRING_DEVICES").otherwise("_LIGHTING"))
    return v("documents").select("doc_id", tx.is_wiring(cat).alias("keep"))


@query("p10_collapse_space", f"SELECT doc_id, trim(regexp_replace(text, '{SPACE_RE2}', ' ', 'g')) AS text FROM documents")
def _(v):
    return v("documents").select("doc_id", tx.collapse_space(F.col("text")).alias("text"))


@query("p26_url_key", "SELECT page_id, substring(sha1(url), 1, 16) AS k FROM pages")
def _(v):
    return v("pages").select("page_id", tx.url_key(F.col("url")).alias("k"))


@query("p33_resolve_path", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('/abs/', page_id) ELSE concat('/lake/rel/', page_id) END AS path FROM pages""")
def _(v):
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/abs/"), F.col("page_id").cast("string"))).otherwise(
        F.concat(F.lit("rel/"), F.col("page_id").cast("string")))
    return v("pages").select("page_id", tx.resolve_path(F.lit("/lake"), p).alias("path"))


# --- verification --------------------------------------------------------------------


def verify_inputs(v, bad: bool = False):
    """All tables the verifier reads, from the crops; ``bad`` plants a leak in every part."""
    crop = v("v_crop")
    ids = rids(v)
    split = cur.holdout_split(crop, ids)
    packs, crops = crop.select("rid").distinct(), crop.select("rid").distinct()
    locked = ids.where("split = 'val'").select("rid")
    meta = ids.agg(F.lit("rid_holdout").alias("split_mode"))
    assigned = split.select("path", "split")
    if bad:
        packs = crop.where("rid <> 'src1'").select("rid").distinct()
        meta = ids.agg(F.lit("random").alias("split_mode"))
        leak = split.where("split = 'val'").select("path", F.lit("train").alias("split"))
        assigned = assigned.unionByName(leak)
        locked = locked.where("rid <> 'src7'")
        crop = crop.withColumn("zoom", F.when(F.col("rid") == "src2", 2.0).otherwise(F.col("zoom")))
    return dict(ids=ids.select("rid"), packs=packs, features=crop.select("rid", "wid", "layer"), crops=crops,
                pool=crop, assigned=assigned, split_ids=ids, locked=locked, meta=meta)


_HEAD = f"""WITH {TRAIN_KEEP}, members AS (SELECT c.* FROM v_crop c SEMI JOIN keep USING (name)), sizes AS (SELECT name, count(*) AS n FROM members WHERE split = 'train' GROUP BY name),
 rids AS (SELECT rid, count(*) AS n FROM v_crop GROUP BY rid)"""
_CLASS = "(SELECT concat('n_classes=', count(*), ' min=', min(n), ' median=', CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT), ' max=', max(n)) FROM sizes)"

query("v1_v12_verify", f"""{_HEAD} SELECT * FROM (VALUES (1, 'source_packs', true, 'missing packs=0'),
 (2, 'bbox_layers', true, (SELECT concat('features=', CAST(sum(n) AS BIGINT), ' fewest per id=', min(n)) FROM rids)), (3, 'crops_exported', true, 'missing crops=0'),
 (4, 'rid_overlap', true, 'shared ids=0'), (5, 'val_rids_locked', true, 'extra=0 absent=0'), (6, 'split_mode', true, 'split_mode=rid_holdout'),
 (7, 'crop_counts', true, (SELECT concat('train=', count(*) FILTER (split = 'train'), ' val=', count(*) FILTER (split = 'val')) FROM members)),
 (8, 'class_stats', true, {_CLASS}), (9, 'label_sanity', true, (SELECT concat('bad labels=0 of ', count(*)) FROM sizes)),
 (10, 'path_leakage', true, 'shared paths=0'), (11, 'wid_leakage', true, 'shared sheets=0'), (12, 'zoom_sanity', true, 'other zooms=0')) t(pos, name, ok, detail)""", "v_crop")(
    lambda v: q.verify(**verify_inputs(v)))

query("v1_v12_verify_leaky", f"""{_HEAD}, nval AS (SELECT count(*) AS n FROM members WHERE split = 'val'), zs AS (SELECT count(*) AS n FROM v_crop WHERE rid = 'src2'),
 alln AS (SELECT name, count(*) AS n FROM members GROUP BY name)
 SELECT * FROM (VALUES (1, 'source_packs', false, 'missing packs=1'),
 (2, 'bbox_layers', true, (SELECT concat('features=', CAST(sum(n) AS BIGINT), ' fewest per id=', min(n)) FROM rids)), (3, 'crops_exported', true, 'missing crops=0'),
 (4, 'rid_overlap', true, 'shared ids=0'), (5, 'val_rids_locked', false, 'extra=1 absent=0'), (6, 'split_mode', false, 'split_mode=random'),
 (7, 'crop_counts', true, (SELECT concat('train=', count(*), ' val=', count(*) FILTER (split = 'val')) FROM members)),
 (8, 'class_stats', true, {_CLASS.replace('sizes', 'alln')}), (9, 'label_sanity', true, (SELECT concat('bad labels=0 of ', count(*)) FROM alln)),
 (10, 'path_leakage', false, (SELECT concat('shared paths=', n) FROM nval)), (11, 'wid_leakage', true, 'shared sheets=0'), (12, 'zoom_sanity', false, (SELECT concat('other zooms=', n) FROM zs))) t(pos, name, ok, detail)""", "v_crop")(
    lambda v: q.verify(**verify_inputs(v, bad=True)))

def broken_inputs(v):
    """The crops with what the other two reports leave whole: an id without boxed features and an id without crops in
    the list, an id in both splits, no train crops but one class, bad names, and sheets in both splits."""
    crop = v("v_crop").withColumn("name", F.lit("bbox_x"))
    crop = crop.withColumn("wid", F.concat("rid", F.lit("-w")).substr(1, 4))
    features = v("v_crop").withColumn("layer", F.when(F.col("rid") == "src1", F.lit("other")).otherwise(F.col("layer"))).select("rid", "wid", "layer")
    ids = rids(v)
    both = ids.unionByName(ids.where("rid = 'src3'").withColumn("split", F.lit("train")))
    return dict(ids=ids.select("rid"), packs=ids.select("rid"), features=features, crops=ids.select("rid"), pool=crop,
                assigned=crop.select("path", F.lit("train").alias("split")), split_ids=both,
                locked=ids.where("split = 'val'").select("rid"), meta=ids.agg(F.lit("rid_holdout").alias("split_mode")))


query("v1_v12_verify_broken", """SELECT * FROM (VALUES (1, 'source_packs', true, 'missing packs=0'),
 (2, 'bbox_layers', false, (SELECT concat('features=', count(*) FILTER (rid <> 'src1'), ' fewest per id=0') FROM v_crop)), (3, 'crops_exported', true, 'missing crops=0'),
 (4, 'rid_overlap', false, 'shared ids=1'), (5, 'val_rids_locked', true, 'extra=0 absent=0'), (6, 'split_mode', true, 'split_mode=rid_holdout'),
 (7, 'crop_counts', false, (SELECT concat('train=', count(*), ' val=0') FROM v_crop)),
 (8, 'class_stats', false, (SELECT concat('n_classes=1 min=', count(*), ' median=', count(*), ' max=', count(*)) FROM v_crop)),
 (9, 'label_sanity', false, 'bad labels=1 of 1: bbox_x'), (10, 'path_leakage', true, 'shared paths=0'),
 (11, 'wid_leakage', false, (SELECT concat('shared sheets=', count(*)) FROM (SELECT substr(concat(rid, '-w'), 1, 4) AS w FROM v_crop GROUP BY w
   HAVING bool_or(split = 'val') AND bool_or(split = 'train' OR rid = 'src3')))), (12, 'zoom_sanity', true, 'other zooms=0')) t(pos, name, ok, detail)""", "v_crop")(
    lambda v: q.verify(**broken_inputs(v)))

query("v3_no_crops", """SELECT * FROM (VALUES (1, 'source_packs', true, 'missing packs=0'),
 (2, 'bbox_layers', true, (SELECT concat('features=', CAST(sum(n) AS BIGINT), ' fewest per id=', min(n)) FROM (SELECT count(*) AS n FROM v_crop GROUP BY rid))),
 (3, 'crops_exported', false, 'missing crops=2')) t(pos, name, ok, detail)""", "v_crop")(
    lambda v: q.verify(**(verify_inputs(v) | {"crops": v("v_crop").where("rid NOT IN ('src1', 'src2')").select("rid").distinct()})))

query("v13_gate", """SELECT false AS ok, CAST(12 AS BIGINT) AS n_checks, 'source_packs,val_rids_locked,split_mode,path_leakage,zoom_sanity' AS failed""", "v_crop")(
    lambda v: q.report_status(q.verify(**verify_inputs(v, bad=True))).withColumn("failed", F.concat_ws(",", "failed")))


query("s18_report_lines", f"""{_HEAD} SELECT * FROM (VALUES (1, '- **PASS** `source_packs` — missing packs=0'),
 (2, (SELECT concat('- **PASS** `bbox_layers` — features=', CAST(sum(n) AS BIGINT), ' fewest per id=', min(n)) FROM rids)), (3, '- **PASS** `crops_exported` — missing crops=0'),
 (4, '- **PASS** `rid_overlap` — shared ids=0'), (5, '- **PASS** `val_rids_locked` — extra=0 absent=0'), (6, '- **PASS** `split_mode` — split_mode=rid_holdout'),
 (7, (SELECT concat('- **PASS** `crop_counts` — train=', count(*) FILTER (split = 'train'), ' val=', count(*) FILTER (split = 'val')) FROM members)),
 (8, concat('- **PASS** `class_stats` — ', {_CLASS})), (9, (SELECT concat('- **PASS** `label_sanity` — bad labels=0 of ', count(*)) FROM sizes)),
 (10, '- **PASS** `path_leakage` — shared paths=0'), (11, '- **PASS** `wid_leakage` — shared sheets=0'), (12, '- **PASS** `zoom_sanity` — other zooms=0')) t(pos, line)""", "v_crop")(
    lambda v: q.report_markdown(q.verify(**verify_inputs(v))))


@query("a5_request_sizes", """SELECT rid, count(DISTINCT wid) AS n_sheets, count(*) FILTER (geometry_type = 3) AS n_boxed FROM v_feature GROUP BY rid""", "v_feature")
def _(v):
    return v("v_feature").groupBy("rid").agg(F.count_distinct("wid").alias("n_sheets"), F.count_if(F.col("geometry_type") == 3).alias("n_boxed"))


@query("a37_label_zoom_sanity", """SELECT rid, array_to_string(list_sort(list_distinct(list(CAST(n_chars % 2 AS VARCHAR)))), ',') AS parities, bool_and(name <> '' AND NOT starts_with(name, 'bbox_')) AS labels_ok, bool_and(abs(zoom - 4) <= 1e-6) AS zoom_ok
 FROM v_crop JOIN documents ON doc_id = crop_id GROUP BY rid""", "v_crop")
def _(v):
    d = v("documents").select(F.col("doc_id").alias("crop_id"), "n_chars")
    return v("v_crop").join(d, "crop_id").groupBy("rid").agg(
        F.array_join(F.array_sort(F.collect_set((F.col("n_chars") % 2).cast("string"))), ",").alias("parities"),
        F.bool_and((F.col("name") != "") & ~F.col("name").startswith("bbox_")).alias("labels_ok"),
        F.bool_and(F.abs(F.col("zoom") - 4) <= 1e-6).alias("zoom_ok"))


# --- training history ----------------------------------------------------------------


@query("w19_best_epochs", """SELECT arm, (SELECT min(epoch) FROM v_history h WHERE h.arm = b.arm AND h.ari = b.best) AS first_best,
 (SELECT max(epoch) FROM v_history h WHERE h.arm = b.arm AND h.ari = b.best) AS last_best FROM (SELECT arm, max(ari) AS best FROM v_history GROUP BY arm) b""", "v_history")
def _(v):
    return cur.best_epochs(v("v_history")).drop("best")


@query("w19_latest_runs", """SELECT event_type AS arm, arg_max(event_id, ts) AS run FROM events GROUP BY event_type""")
def _(v):
    runs = v("events").select(F.col("event_type").alias("arm"), F.col("event_id").alias("run"), F.col("ts").alias("modified"))
    return cur.latest_runs(runs)


@query("w20_early_stop", """WITH g AS (SELECT arm, epoch, ari, coalesce(ari > max(ari) OVER (PARTITION BY arm ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gain FROM v_history),
 s AS (SELECT *, epoch - max(CASE WHEN gain THEN epoch END) OVER (PARTITION BY arm ORDER BY epoch) AS since FROM g)
 SELECT arm, coalesce(min(epoch) FILTER (since >= 5), max(epoch)) AS stop_epoch, bool_or(since >= 5) AS stopped_early FROM s GROUP BY arm""", "v_history")
def _(v):
    return cur.early_stop(v("v_history"))


# --- corpus profile ------------------------------------------------------------------


@query("a7_geometry_counts", "SELECT geometry_type, count(*) AS n FROM v_feature GROUP BY geometry_type", "v_feature")
def _(v):
    return prof.geometry_counts(v("v_feature"))


@query("a7_top_layers", "SELECT name, count(*) AS n FROM v_feature GROUP BY name ORDER BY n DESC, name LIMIT 10", "v_feature")
def _(v):
    return prof.top_layers(v("v_feature"))


_PROFILE = "count(*) AS n_units, avg(n) AS mean, min(n) AS min, max(n) AS max, quantile_cont(n, 0.95) AS p95, round(stddev_samp(n), 9) AS std"


@query("a8_points_profile", f"SELECT {_PROFILE} FROM (SELECT rid, wid, count(*) AS n FROM v_feature WHERE geometry_type = 1 GROUP BY rid, wid)", "v_feature")
def _(v):
    return prof.profile(prof.points_per_sheet(v("v_feature"))).withColumn("std", F.round("std", 9))


@query("a9_dominant_names", f"""WITH o AS (SELECT rid, name, count(*) AS n FROM v_feature GROUP BY rid, name), l AS (SELECT rid, quantile_cont(n, 0.95) AS p FROM o GROUP BY rid)
 SELECT {_PROFILE} FROM (SELECT rid, count(*) AS n FROM o JOIN l USING (rid) WHERE n >= p GROUP BY rid)""", "v_feature")
def _(v):
    return prof.profile(prof.dominant_names(v("v_feature"))).withColumn("std", F.round("std", 9))


@query("a33_build_statistics", """SELECT count(*) AS annotation_count, count(DISTINCT sheet_id) AS image_count, count(DISTINCT name) AS category_count FROM v_gt""", "v_gt")
def _(v):
    return prof.build_statistics(v("v_gt"), ["sheet_id"], "name")


@query("a33_category_distribution", "SELECT name, count(*) AS n FROM v_gt GROUP BY name", "v_gt")
def _(v):
    return prof.category_distribution(v("v_gt"), "name")


@query("s17_feature_names", "SELECT DISTINCT name AS value FROM v_feature", "v_feature")
def _(v):
    from boxlake.sources.writers import feature_names

    return feature_names(v("v_feature"))


@query("j18_class_categories", """SELECT name, category, category_id FROM (SELECT DISTINCT name, CASE WHEN regexp_matches(name, '^(.*URGENT.*)') THEN 'URGENT' WHEN regexp_matches(name, '^([1-3]-.*)') THEN 'HIGH' WHEN regexp_matches(name, '^(.*LOW.*)') THEN 'LOW' END AS category,
 CAST(CASE WHEN regexp_matches(name, '^(.*URGENT.*)') THEN 0 WHEN regexp_matches(name, '^([1-3]-.*)') THEN 1 WHEN regexp_matches(name, '^(.*LOW.*)') THEN 2 END AS BIGINT) AS category_id FROM v_feature) WHERE category IS NOT NULL AND category <> 'LOW'""", "v_feature")
def _(v):
    from boxlake.operators.templates import class_categories

    from boxlake.sources.readers import parse_category_map

    lines = ["layer_name_regex,category_name,category_id", ".*LOW.*,LOW,2", "[1-3]-.*,HIGH,1", "", ".*URGENT.*,URGENT,0"]
    rules = parse_category_map(v.spark.createDataFrame([(x,) for x in lines], "value string"))
    return class_categories(v("v_feature"), rules, exclude=["LOW"])


@query("j18_native_categories", "SELECT name, name AS category, row_number() OVER (ORDER BY name) - 1 AS category_id FROM (SELECT DISTINCT name FROM v_feature)", "v_feature")
def _(v):
    from boxlake.operators.templates import class_categories

    return class_categories(v("v_feature"), None)
