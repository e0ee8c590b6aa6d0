"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram is the product of its letters' vectors, each
rotated by its place; a document is the sum of its trigrams, a language the sum of its documents. The nearest
language by cosine wins; ties go to the language that sorts first.

Null texts and texts without a letter are ``und`` with score 0, and so is every text when nothing could be
learned. Rows never meet at prediction: repeated rows get equal results and null ids pass through (they are
never learned from). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from boxlake.llm.common import fold, slices, small_table

UNDETERMINED = "und"
#: a column of languages has no more values; each costs the driver one vector
MAX_LANGUAGES = 2000


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # one unit row per language
    dims: int
    seed: int


class Space:
    """Document vectors. Letters' vectors come from the seed and the code point alone."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed, self.known = dims, seed, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dims)
            self.known[code] = (2 * bits - 1).astype(np.float32)
        return self.known[code]

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, whether the text has a letter). Runs of other characters count as one boundary."""
        joined = "\0".join(t.lower() for t in texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        alphabet, at = np.unique(codes, return_inverse=True)
        is_letter = np.array([chr(c).isalpha() for c in alphabet])
        place = np.where(is_letter, np.cumsum(is_letter), 0)
        letters = np.concatenate([[0], alphabet[is_letter]])
        sym = place[at]
        sizes = np.array([len(t.lower()) + 1 for t in texts])
        doc = np.repeat(np.arange(len(texts)), sizes)
        keep = (sym > 0) | np.concatenate([[True], sym[:-1] > 0])
        has = np.bincount(doc, sym > 0, len(texts)) > 0
        sym, doc, n = sym[keep], doc[keep], len(letters)
        tri = (sym[:-2] * n + sym[1:-1]) * n + sym[2:] if len(sym) > 2 else np.empty(0, np.int64)
        own = doc[:-2] == doc[2:] if len(sym) > 2 else np.empty(0, bool)
        tri, doc = tri[own], doc[:-2][own] if len(sym) > 2 else doc[:0]
        if n ** 3 <= 1 << 22:
            grams = np.flatnonzero(np.bincount(tri, minlength=1))
            col = np.zeros(n ** 3, np.int64)
            col[grams] = np.arange(len(grams))
            col = col[tri]
        else:
            grams, col = np.unique(tri, return_inverse=True)
        out, step = np.zeros((len(texts), self.dims), np.float32), 2048
        if not len(grams):
            return out, has
        base = np.stack([self.letter(int(c)) for c in letters])
        first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
        order = np.argsort(col // step, kind="stable") if len(grams) > step else slice(None)
        col, doc = col[order], doc[order]
        bounds = np.searchsorted(col // step, np.arange(-(-len(grams) // step) + 1))
        for k, lo in enumerate(range(0, len(grams), step)):
            g, s = grams[lo:lo + step], slice(bounds[k], bounds[k + 1])
            counts = np.bincount(doc[s] * len(g) + col[s] - lo, minlength=len(texts) * len(g))
            bound = first[g // (n * n)] * second[g // n % n] * base[g % n]
            out += counts.reshape(len(texts), len(g)).astype(np.float32) @ bound
        return out, has


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", dims: int = 1024,
          seed: int = 7, max_per_lang: int = 2000) -> Profiles:
    """Profiles from about ``max_per_lang`` documents of each language, taken by hash of the id from all
    learning rows (the bound of the sample). Only one vector per language reaches the driver."""
    rows = (docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("y"))
            .where((fold(F.col("i")) != 0) & F.col("y").isNotNull() & F.col("t").isNotNull()))
    counts = rows.groupBy("y").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang}: not a column of languages")
    # at most MAX_LANGUAGES rows in a table of known size: Spark sends it to the tasks and leaves the texts in place
    share = small_table(docs.sparkSession, y=pa.array([r["y"] for r in counts], pa.string()),
                        share=pa.array([max_per_lang / r["count"] for r in counts], pa.float64()))
    draw = (F.xxhash64(F.col("i"), F.lit(seed)) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    sample = rows.join(share, "y").where(draw < F.col("share")).select("t", "y")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dims, seed), {}
        for b in slices(batches, "t", 1 << 19):
            vectors, _ = space.documents(b.column("t").to_pylist())
            langs = np.array(b.column("y").to_pylist(), object)
            for y in set(langs):
                sums[y] = sums.get(y, 0) + vectors[langs == y].sum(axis=0, dtype=np.float64)
        for y, v in sums.items():
            yield pa.RecordBatch.from_pydict({"y": [y] * dims, "d": np.arange(dims), "v": v})

    parts = sample.mapInArrow(bundle, "y string, d long, v double").groupBy("y", "d").agg(F.sum("v").alias("v"))
    found = sorted(parts.collect())
    languages = sorted({r["y"] for r in found})
    vectors = np.array([r["v"] for r in found], float).reshape(len(languages), dims)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles(languages, vectors / np.where(norm > 0, norm, 1), dims, seed)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` with the language and its score (cosine, 0 to 1), called ``names``."""
    source = text if text in keep else "_text"
    chosen = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    schema = StructType([chosen.schema[i] for i in range(len(keep))]).add(names[0], StringType()).add(names[1], DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(profiles.dims, profiles.seed)
        for b in slices(batches, source, 1 << 19):
            vectors, has = space.documents([t or "" for t in b.column(source).to_pylist()])
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            langs, score = [UNDETERMINED] * len(has), np.zeros(len(has))
            if profiles.languages:
                cosine = vectors @ profiles.vectors.T / np.where(norm > 0, norm, 1)
                best = cosine.argmax(axis=1)
                score = np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                langs = [profiles.languages[k] if h else UNDETERMINED for k, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array(langs, pa.string()), pa.array(score.astype(float))], [*keep, *names])

    return chosen.mapInArrow(run, schema)


def keep_known(docs: DataFrame, profiles: Profiles, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows whose language is known: a letter, and at least ``min_score`` likeness to a learned language.
    Very short clean texts have little likeness to any, so by default only the first counts."""
    judged = predict(docs, profiles, text, tuple(docs.columns), ("_lang_pred", "_lang_score"))
    return judged.where((F.col("_lang_pred") != UNDETERMINED) & (F.col("_lang_score") >= min_score)).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    predicted = predict(docs, learn(docs))
    return predicted.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
