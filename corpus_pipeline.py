"""From raw documents to token ids: five stages, each an operator of souk.llm.

Each stage reads what its predecessor kept, written as Parquet; all but the last return the columns
of documents. Repeated rows, null keys and null texts are handled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import bpe, decontaminate, exact, simhash, toxicity
from souk.llm.queries import TOXIC_HELD_OUT, held_out
from souk.llm.shared import settle, table


def _as_given(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay."""
    out = held_out(*TOXIC_HELD_OUT)
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"), lambda key: ~out(key))
    return _as_given(toxicity.score_toxicity(docs, model).where("__score < 0.5"), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near fingerprints the smallest doc_id stays."""
    return simhash.simhash_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item stay."""
    marked = decontaminate.mark_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _as_given(marked.where(~decontaminate.leaked()), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of the ids and of the bytes decoded from them."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                              public_tokenizers.PATTERN).withColumnRenamed("key", "doc_id")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash_dedup", drop_near_copies),
          ("decontamination", drop_contaminated), ("byte_bpe", encode_tokens)]

ORACLE_SQL = None  # SQL can express neither the classifier nor the fingerprints


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
