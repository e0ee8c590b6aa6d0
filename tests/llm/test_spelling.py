"""Spelling variants against deletion neighbourhoods over a dictionary."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from boxlake.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def within_one(a, b):
    """The usual table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] == 1


def by_force(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    holes = defaultdict(set)
    for w in n:
        holes[w].add(w)
        for k in range(len(w)):
            holes[w[:k] + w[k + 1:]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if b != a and within_one(a, b)}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def check(docs, **how):
    got = spelling.digest(docs, **how)
    assert got.columns == COLUMNS
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    return rows


def test_given_documents(spark, sf_dir):
    assert len(check(spark.read.parquet(f"{sf_dir}/documents.parquet"))) > 100


@pytest.mark.parametrize("size", [2048, 7])
def test_planted_variants(spark, size):
    """Variants of variants, anagrams, letters beyond ASCII; small pieces cut the blocks."""
    r, words = random.Random(1), []
    alphabet = "abcdeiorstnàéÿ×"
    for _ in range(60):
        w = "".join(r.choice(alphabet) for _ in range(r.randint(6, 9)))
        n = r.choice([5, 6, 30, 200, 900])
        words += [w] * n + ["".join(r.sample(w, len(w)))] * 5
        for _ in range(4):
            k, n = r.randrange(len(w)), max(5, n // r.choice([2, 5, 6]))
            w = r.choice([w[:k] + w[k + 1:], w[:k] + r.choice(alphabet) + w[k:], w[:k] + r.choice(alphabet) + w[k + 1:]])
            words += [w] * n
    r.shuffle(words)
    docs = [(k, " ".join(words[k::50]).upper() if k % 9 else " ".join(words[k::50])) for k in range(50)]
    rows = check(spark.createDataFrame(docs, "doc_id long, text string"), size=size)
    assert any(x[1] and x[2] != x[1] for x in rows)


def test_long_runs_and_awkward_rows(spark, awkward, nothing):
    long = ["ab" * 1100, "ab" * 1100 + "c", "ab" * 1099 + "ac", "ba" * 1100]
    rows = [(k, " ".join(long), "en") for k in range(6)]
    check(awkward.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert spelling.digest(nothing).collect() == []
