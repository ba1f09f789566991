"""The corpus pipeline: what a training corpus goes through, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Null texts count
as empty, empty tables pass through, and further columns of documents are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import byte_bpe, exact_dedup, jaccard_join, pareto_mix, toxicity
from faultline.llm.queries import VOCABULARY, training_rows
from faultline.llm.registry import table
from faultline.llm.tables import col, fresh, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half; learned from the labels that may be learned from."""
    model = toxicity.train(docs, training_rows(table(spark, sf_dir, "labels")), "doc_id", "text", "toxic")
    (score,) = fresh(docs, "score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).select([col(name) for name in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those with equal texts."""
    return exact_dedup.without_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at a Jaccard similarity of 0.8 or more."""
    return jaccard_join.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; documents are repeated or left out."""
    return pareto_mix.mixed(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, and whether decoding them gives the text's bytes back.

    doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256.
    """
    ranks = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("raw", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near duplicates", without_near_copies),
    ("mix", mixed),
    ("tokenise", tokenised),
]

# The classifier, the similarity join and the tokeniser have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
