"""Quality rules: a threshold table compiled into one projection, with built-in functions only.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage
return. Null and empty texts have no words and fail the base rule. Rows never meet, so repeated rows,
null ids and extra columns need no care; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import let, text_of

BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BULLETS = ["-", "*", "•", "·", "+"]
UPPERS = "A-ZÀ-ÖØ-Þ"
# frequent short words of the languages at hand: fixed values
STOP_WORDS = ("the of and to in is that it for with as are this by be on de la le les et des du en que qui un une "
              "pour dans der die das und den ist von zu mit nicht ein el los las del y por con para se").split()
STOP_FORMS = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]


@dataclass(frozen=True)
class Threshold:
    """Keep a text when ``low <= metric <= high``; an open end is None."""

    metric: str
    low: float | None = None
    high: float | None = None


THRESHOLDS = (
    Threshold("mean_word_chars", 2.0, 18.0),
    Threshold("symbols_per_word", high=0.25),
    Threshold("bangs_per_word", high=0.5),
    Threshold("upper_share", high=0.5),
    Threshold("stop_word_share", low=0.02),
    Threshold("dup_line_share", high=0.5),
    Threshold("bullet_line_share", high=0.9),
    Threshold("ellipsis_line_share", high=0.5),
)
#: metric: (numerator, denominator) over the counts below; an empty denominator gives 0
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "bangs_per_word": ("n_bangs", "n_words"), "upper_share": ("n_upper", "word_chars"),
    "stop_word_share": ("n_stop", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "bullet_line_share": ("n_bullets", "n_lines"), "ellipsis_line_share": ("n_ellipses", "n_lines"),
}


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more: sort the windows, look at neighbours."""
    last = F.size(words) - 3
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: let(
        F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c")),
        lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"), i.alias("i"))))

    def same(s: Column, x: Column, j: Column) -> Column:
        y = F.get(s, j)
        return F.coalesce((y["h"] == x["h"]) & (y["g"] == x["g"]), F.lit(False))

    def covered(s: Column) -> Column:
        hits = F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(
            hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(last >= 1, let(F.sort_array(grams), covered)).otherwise(0)


def _counts(text: Column) -> Column:
    """All counts of one text as a struct; split and sort once each."""
    spaced = text
    for c in BLANKS:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(spaced, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def number(chars: str) -> Column:
        return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))

    def build(w: Column, ls: Column) -> Column:
        return F.struct(*[c.cast("long").alias(n) for n, c in {
            "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_symbols": number(SYMBOLS),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)), "n_repeat_words": _repeat_words(w),
            "n_lines": F.size(ls), "n_bangs": number("!"),
            "n_upper": F.length(text) - F.length(F.regexp_replace(text, f"[{UPPERS}]+", "")),
            "n_stop": F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))),
            "n_bullets": F.size(F.filter(ls, lambda x: F.substring(F.ltrim(x), 1, 1).isin(BULLETS))),
            "n_ellipses": F.size(F.filter(ls, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        }.items()])

    return let(words, lambda w: let(lines, lambda ls: build(w, ls)))


def metric(name: str, counts: Column) -> Column:
    num, den = RATIOS[name]
    return F.when(counts[den] > 0, counts[num].cast("double") / counts[den]).otherwise(F.lit(0.0))


def judge(docs: DataFrame, text: str = "text", out: str = "quality",
          thresholds: tuple[Threshold, ...] = THRESHOLDS, min_words: int = 50,
          max_repeat_pct: int = 50) -> DataFrame:
    """Add struct ``out`` with the counts, the ratios, ``base_failed``, ``failed`` (names of missed thresholds)
    and ``kept``. A column that is already called ``out`` is replaced."""
    counted = docs.withColumn("_counts", _counts(text_of(text)))
    c = F.col("_counts")
    base = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_pct * c["n_words"])
    missed = []
    for t in thresholds:
        m = metric(t.metric, c)
        bad = F.lit(False)
        if t.low is not None:
            bad = bad | (m < t.low)
        if t.high is not None:
            bad = bad | (m > t.high)
        missed.append(F.when(bad, F.lit(t.metric)))
    failed = F.array_compact(F.array(*missed)) if missed else F.array().cast("array<string>")
    return counted.withColumn(out, let(failed, lambda f: F.struct(
        c.alias("counts"), base.alias("base_failed"), f.alias("failed"),
        (~base & (F.size(f) == 0)).alias("kept")))).drop("_counts")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: id, base counts, ``base_failed`` and ``kept``."""
    q = F.col("_quality")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judge(docs.select("doc_id", "text"), out="_quality")
    return judged.select("doc_id", *[q["counts"][n].alias(n) for n in counts],
                         q["base_failed"].alias("base_failed"), q["kept"].alias("kept"))


def oracle() -> str:
    """The same rows in DuckDB: windows as rows, counted by a window function."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    conds = []
    for t in THRESHOLDS:
        num, den = RATIOS[t.metric]
        m = f"(CASE WHEN {den} > 0 THEN {num}::DOUBLE / {den} ELSE 0 END)"
        conds += [f"{m} >= {t.low}"] * (t.low is not None) + [f"{m} <= {t.high}"] * (t.high is not None)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
        list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '),
                    lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, {blanks}, '')) > 0) AS l FROM documents),
    g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
    h AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g),
    p AS (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM h WHERE c > 1),
    rep AS (SELECT r, count(DISTINCT pos) AS n FROM p GROUP BY r),
    c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, {blanks}, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, {q(SYMBOLS)}, '')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(l) AS n_lines, length(t) - length(translate(t, '!', '')) AS n_bangs,
        length(t) - length(regexp_replace(t, '[{UPPERS}]', '', 'g')) AS n_upper,
        len(list_filter(w, lambda x: list_contains([{', '.join(map(q, STOP_FORMS))}], x))) AS n_stop,
        len(list_filter(l, lambda x: list_contains([{', '.join(map(q, BULLETS))}], substr(ltrim(x, ' '), 1, 1)))) AS n_bullets,
        len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipses
      FROM d LEFT JOIN rep USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {' AND '.join(conds)} AS kept FROM b"""
