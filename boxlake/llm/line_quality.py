"""Quality classifier: a linear-chain CRF marks every line good or bad.

A line sees counts of its own characters and words and those of its neighbours. The chain learns from
labelled documents, whose label holds for each of their lines; a document's score is the mean of its lines'
forward-backward marginals, weighted by line length.

Null and empty texts are one empty line and get a score like any other. Rows never meet at scoring: repeated
rows get equal scores and null ids pass through (they are never learned from). A label that is null, or an id
labelled both ways, teaches nothing. Without labels every score is 0.5. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from boxlake.llm import crf
from boxlake.llm.common import fold, slices

THRESHOLD = 0.3
CLASSES = ("lower", "upper", "digit", "blank", "stop", "bang", "symbol", "bar", "other")
_SIGNS = {"stop": ".,;:'\"()-–—’“”«»…", "bang": "!?¡¿", "symbol": "#*$%&<>=+~^_@\\/[]{}`", "bar": "|"}


def _class_table(size: int = 0x3000) -> np.ndarray:
    """Character class by code point; letters without case and all beyond the table count as lower."""
    table = np.zeros(size, np.int64)
    for c in range(size):
        ch = chr(c)
        signs = next((k for k, s in _SIGNS.items() if ch in s), None)
        kind = signs or ("digit" if ch.isdigit() else "upper" if ch.isupper() else "blank" if ch.isspace()
                         else "lower" if ch.isalpha() else "other")
        table[c] = CLASSES.index(kind)
    return table


TABLE = _class_table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lines per text, characters per line)."""
    split = [t.split("\n") for t in texts]
    per_text = np.array([len(x) for x in split], np.int64)
    lines = [x for ls in split for x in ls]
    size = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = TABLE[np.minimum(codes, len(TABLE) - 1)]
    at = np.repeat(np.arange(len(lines)), size)
    k = len(CLASSES)
    count = np.bincount(at * k + kind, minlength=len(lines) * k).reshape(-1, k)
    words = [x.split() for x in lines]
    n_words = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    seen = np.concatenate([_again(ls) for ls in split]) if split else np.empty(0)
    full = np.maximum(size, 1)[:, None]
    own = np.column_stack([
        np.log1p(size), count / full, np.log1p(n_words), (size - count[:, CLASSES.index("blank")]) / np.maximum(n_words, 1),
        1 - distinct / np.maximum(n_words, 1), np.minimum(distinct, 20) / np.minimum(np.maximum(n_words, 1), 20) * (n_words > 5),
        size == 0, n_words <= 2, seen,
        count[:, CLASSES.index("bang")] / np.maximum(n_words, 1), count[:, CLASSES.index("symbol")] / np.maximum(n_words, 1),
        count[:, CLASSES.index("bar")] / np.maximum(n_words, 1)])
    starts = np.cumsum(per_text) - per_text
    first, last = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    first[starts], last[starts + per_text - 1] = True, True
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
    return np.column_stack([own, before, after, first, last]).astype(np.float32), per_text, size


def _again(lines: list[str]) -> np.ndarray:
    """Whether a line equals an earlier one of its text."""
    seen, out = set(), np.zeros(len(lines))
    for i, x in enumerate(lines):
        out[i] = x in seen
        seen.add(x)
    return out


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          max_docs: int = 3000) -> crf.Chain | None:
    """Fit on the ``max_docs`` labelled documents of learning folds that come first by hash of their id (the
    bound of the sample; their line features, not their texts, reach the driver). None without labels."""
    known = (labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y"))
             .where((fold(F.col("i")) != 0) & F.col("y").isin(0, 1))
             .groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
             .orderBy(F.xxhash64("i"), "i").limit(max_docs))
    # at most max_docs rows of two numbers: Spark knows that limit and sends them to the tasks
    sample = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(known, "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            x, per_text, _ = line_features([t or "" for t in b.column("t").to_pylist()])
            ends = np.cumsum(per_text)
            yield pa.RecordBatch.from_pydict({
                "i": b.column("i"), "y": b.column("y"), "n": per_text,
                "x": [x[e - n:e].tobytes() for e, n in zip(ends, per_text, strict=True)]})

    kind = sample.schema["i"].dataType.simpleString()
    rows = sorted(sample.mapInArrow(run, f"i {kind}, y int, n long, x binary").collect())
    if not rows:
        return None
    lengths = np.array([r["n"] for r in rows])
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(lengths.sum(), -1).astype(float)
    return crf.fit(x, lengths, np.repeat([r["y"] for r in rows], lengths))


def score_texts(chain: crf.Chain | None, texts: list[str]) -> np.ndarray:
    if chain is None or not texts:
        return np.full(len(texts), 0.5)
    x, per_text, size = line_features(texts)
    p, doc = crf.marginals(chain, x, per_text), np.repeat(np.arange(len(texts)), per_text)
    weight = size + 1.0
    return np.clip(np.bincount(doc, p * weight) / np.bincount(doc, weight), 0, 1)


def score(docs: DataFrame, chain: crf.Chain | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with the document's score."""
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    schema = StructType([chosen.schema[i] for i in range(len(keep))]).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            s = score_texts(chain, [t or "" for t in b.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(s)], [*keep, "score"])

    return chosen.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
