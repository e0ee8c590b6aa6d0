"""Shapes of the physical plans."""

import glob
import os
import re

import pytest

from tests.duck import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LAZY = ["j6_center_hits", "j7_point_hits", "j8_iou_pairs", "j9_label_candidates", "j10_assign_tiles", "j12_window_neighbours", "j13_densest_point",
        "j14_boxes_on_tiles", "j22_covered_patches", "j24_clip_to_roi", "a28_covering_choice", "a1_class_counts", "a4_split_stats", "a9_dominant_names",
        "w7_cap_per_class", "w4_sheet_split", "j20_positive_pairs", "a25_visible_paths", "a30_otsu", "w11_jumps", "w13_group_rows", "j1_resolve_tags", "p8_electrical_filter"]


@pytest.fixture(autouse=True)
def nothing_cached(spark):
    """A table that another test has cached would stand in for its scan."""
    spark.catalog.clearCache()


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python(spark, sf_dir, name):
    p = plan(spark, sf_dir, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in p


def test_top_n_is_cut_before_the_shuffle(spark, sf_dir):
    p = plan(spark, sf_dir, "w7_cap_per_class")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    p = plan(spark, sf_dir, "a1_class_counts")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert "text" not in schema and "n_chars" in schema


@pytest.mark.parametrize("name", ["a11_sweep", "a11_sweep_per_sheet"])
def test_sweeps_broadcast_nothing(spark, sf_dir, name):
    """Joins of tables with a row per sheet and detector, or per box, went through the driver while they looked small."""
    assert "BroadcastHashJoin" not in plan(spark, sf_dir, name)


def test_vocabulary_copies_no_text_per_term(spark, sf_dir):
    """Terms are picked by a filter inside the row; a generator over all terms would copy each text 129 times."""
    p = QUERIES["u6_vocabulary"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(filter(" in p and "Filter Contains" not in p


def test_wiring_boxes_are_parsed_once(spark, sf_dir):
    """The box is a column of a generator, so the filter on it does not parse the ring again."""
    p = QUERIES["p7b_reference_polygons"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("JsonToStructs") + p.count("from_json(") <= 2


def test_code_rules():
    """No local checkpoints, broadcast hints, cross joins or row-wise Python UDFs in the library."""
    for f in glob.glob(f"{ROOT}/boxlake/**/*.py", recursive=True):
        text = open(f).read()
        for bad in (".localCheckpoint(", "broadcast(", "crossJoin(", "F.udf(", ".toPandas(", ".rdd.map"):
            assert bad not in text, (f, bad)
