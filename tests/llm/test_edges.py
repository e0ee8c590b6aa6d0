"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest

from boxlake.llm import (
    decontaminate, html_extract, language_id, licenses, line_quality, near_dup, packing, quality_rules, suffix_dedup, url_filter,
)

from .conftest import AWKWARD


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 1), (11, 0), (12, 0), (None, 1), (6, None), (7, 0), (7, 1)], "doc_id long, quality int")


@pytest.fixture
def benchmark(spark):
    item = "the dog lay by the door of the house near the old mill"
    return spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "word"), (None, item)], "item_id long, text string")


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


ALL = sorted((i is None, i or 0) for i, _, _ in AWKWARD)


def test_one_row_per_row(awkward, labels):
    for out in (suffix_dedup.digest(awkward), licenses.digest(awkward), line_quality.digest(awkward, labels),
                quality_rules.digest(awkward), near_dup.digest(awkward), language_id.digest(awkward)):
        assert ids(out) == ALL


def test_empty_tables(nothing, labels, benchmark, spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (suffix_dedup.digest(nothing), licenses.digest(nothing), line_quality.digest(nothing, labels.where("false")),
                quality_rules.digest(nothing), near_dup.digest(nothing), language_id.digest(nothing), packing.digest(nothing),
                decontaminate.digest(nothing, benchmark), url_filter.digest(pages), html_extract.digest(pages),
                near_dup.deduplicate(nothing), suffix_dedup.cut_repeats(nothing)):
        assert out.count() == 0


def test_no_benchmark_no_leaks(awkward, benchmark):
    assert decontaminate.digest(awkward, benchmark.where("false")).count() == 0
    assert decontaminate.remove_leaks(awkward, benchmark.where("false")).count() == len(AWKWARD)


def test_leaks(awkward, benchmark):
    found = {(r.doc_id, r.item_id) for r in decontaminate.digest(awkward, benchmark).collect()}
    assert found == {(1, 1), (2, 1), (1, None), (2, None)}
    left = decontaminate.remove_leaks(awkward, benchmark)
    assert left.columns == awkward.columns and left.count() == len(AWKWARD) - 2


def test_blank_texts_stand_alone(awkward):
    rows = {r.doc_id: r for r in near_dup.digest(awkward).collect()}
    for i in (3, 4, 5):
        assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (0, i, True)
    assert (rows[2].component_id, rows[2].kept) == (1, False)
    assert rows[10].n_shingles == 2 and rows[9].n_shingles == 1
    left = near_dup.deduplicate(awkward)
    assert left.columns == awkward.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, *range(3, 14)]


def test_languages(awkward):
    rows = {(r.doc_id, r.held_out): r for r in language_id.digest(awkward).collect()}
    by = {k[0]: r for k, r in rows.items()}
    for i in (3, 4, 5, 11, 12):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[1].lang_pred in {"en", "fr", "de"} and 0 < by[1].score <= 1
    kept = language_id.keep_known(awkward, language_id.learn(awkward))
    assert kept.columns == awkward.columns and not {3, 4, 5, 11, 12} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(awkward, labels, spark):
    unknown = awkward.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.digest(unknown).collect()} == {"und"}
    assert {r.score for r in line_quality.digest(awkward, labels.where("false")).collect()} == {0.5}


def test_null_text_is_empty(awkward):
    rows = {r.doc_id: r for r in suffix_dedup.digest(awkward).collect()}
    assert (rows[3].n_bytes, rows[3].n_removed, rows[3].n_spans) == (0, 0, 0)
    assert rows[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].n_removed == rows[2].n_bytes and rows[1].n_removed == 0
    assert rows[9].n_removed == 0  # repeats inside a document stay
    left = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(awkward).collect()}
    assert left[3] is None and left[2] == "" and left[8] == AWKWARD[7][1]


def test_licenses_of_blank_texts(awkward):
    rows = {r.doc_id: r for r in licenses.digest(awkward).collect()}
    assert (rows[3].n_words, rows[3].n_base, rows[3].first_word, rows[3].base_labels, rows[3].labels, rows[3].score) == (0, 0, None, "", "", 0.0)


def test_rules_of_blank_texts(awkward):
    rows = {r.doc_id: r for r in quality_rules.digest(awkward).collect()}
    assert (rows[3].n_words, rows[3].base_failed, rows[3].kept) == (0, True, False)
    assert rows[8].n_words == 10 and rows[10].n_dup_lines == 29_999 and rows[10].n_repeat_words == 60_000


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme.example.net/en/"), (4, "https://A.Example.NET/en/x?y"), (5, "http://x.example.net/en"),
            (6, "HTTP://x.org/fr/?q#f"), (7, "http://b.net"), (8, "http://b.net/"), (9, "http://example.com/de/a"),
            (10, "http://notexample.com/de/a"), (11, "http://casino.example.org/"), (12, "http://net/?a=http://x.org/fr/"), (None, "http://b.net/"),
            (13, "http://free-bets.example.net/en/1"), (14, "x://"), (15, "http://x.example.org#f/fr/"), (8, "http://b.net/")]
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in rows], "page_id long, url string, host string, path string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.digest(df).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        5: ("x.example.net", "/en", "net/", "block"), 6: ("x.org", "/fr/", "org/fr/", "allow"), 7: ("b.net", "", None, "allow"),
        8: ("b.net", "/", "net/", "block"), 9: ("example.com", "/de/a", "example.com/de/", "block"), 10: ("notexample.com", "/de/a", None, "allow"),
        11: ("casino.example.org", "/", None, "block"), 12: ("net", "/", "net/", "block"), None: ("b.net", "/", "net/", "block"),
        13: ("free-bets.example.net", "/en/1", "example.net/en/", "allow"), 14: ("", "", None, "allow"), 15: ("x.example.org", "", None, "allow")}
    assert url_filter.digest(df).count() == len(rows)


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<article><p>A &amp; b.<p>C" + "&nbsp;d" * 3 + "</article>"), (4, "u", "<script>x"),
            (5, "u", "plain < text > here"), (6, "u", "<div>" * 30_000 + "deep")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.digest(df).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.text) for r in got}
    assert {(1, ""), (2, ""), (None, ""), (4, ""), (4, "A & b. C d d d")} <= by
    assert all(r.n_chars == len(r.text) for r in got)
