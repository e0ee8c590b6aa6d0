"""Training-data pipeline over ``documents``, of five of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between stages ``run`` writes the rows to the shared checkpoint folder, so no stage computes the
ones before it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm import decontaminate, language_id, near_dup, packing, suffix_dedup
from boxlake.llm.common import read
from boxlake.session import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told: those without a letter."""
    return language_id.keep_known(docs, language_id.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates: five words at 80%, or op7's three words at 85%.

    Neither rule holds the other: a block added or taken away tells less at five words and 80%, single words
    changed here and there tell less at three words and 85%."""
    return near_dup.deduplicate(docs, rules=((5, 80), (near_dup.SHINGLE, near_dup.PERCENT)))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that also stand in a document with a smaller id; ``n_chars`` follows the text."""
    left = suffix_dedup.cut_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of ``benchmark``."""
    return decontaminate.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 1024."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("contamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: sketches, random walks and a tokenizer are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
