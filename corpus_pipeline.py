"""From raw documents to packed training sequences: five stages, each an operator of geoquilt.llm.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents
(the last returns the packing). Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from geoquilt.llm import mixing, ngram_join, packing, substrings, toxicity
from geoquilt.llm.shared import written

THRESHOLD = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below the threshold; labels of held-out documents are not learned from."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), THRESHOLD)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of five-word Jaccard 0.8 or more stays."""
    return ngram_join.kept(docs, 5, Fraction(8, 10))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that an earlier document has are cut out; a text that loses nothing keeps its exact form.

    n_chars follows a changed text. A document that loses all its words goes.
    """
    return substrings.cleaned(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (whole documents only), so a document may come twice or not at all."""
    return mixing.drawn(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of what is left, into sequences of 2048 tokens; a document that was drawn twice is packed twice."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), fine_units=True)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("mixing", mixed_sources),
    ("best_fit_packing", packed),
]

#: A learned classifier, a sketch and a genetic search stand in it: tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
