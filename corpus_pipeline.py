"""The corpus pipeline: five filtering steps from raw documents to packed sequences.

``STAGES`` lists (name, function) in order. A function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm import decontam, linededup, packing, simhash, toxicity
from mirador.llm.common import staged, table
from mirador.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored 0.7 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=3, held=1)
    return toxicity.reject(docs, model, threshold=0.7)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines of 10 documents or more go everywhere. A document that loses all
    of its text stays, empty."""
    kept = linededup.drop_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of documents that chains of fingerprints at most 3 bits apart link one stays."""
    return simhash.keep_linked(docs, shingle_words=3, radius=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: A learned score decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
