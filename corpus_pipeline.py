"""The training-data pipeline: five stages over the documents table, each written and read again.

Every stage but the last returns the columns of documents. Rows with nulls, empty or very long texts and
repeated rows pass through each stage as the stage's operator defines; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from lexigrid.llm.common import shared_folder, table
from lexigrid.llm.queries import tokenizer_file
from lexigrid.session import delete


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold. The classifier learns from all folds' labels but the held-out one.

    Rows are judged one by one by their texts: repeated rows and null ids stay or go by them; null and empty texts
    score the label's share among examples without a mark, which is far below the threshold. Without labels every
    row stays. An empty table stays empty; columns of any name are kept.
    """
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.drop_toxic(docs, index)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id.

    Null texts count as empty. Rows that repeat the smallest id all stay; a null id stays if no other id has its text;
    of a repeated id with several texts only those go that a smaller id has. An empty table stays empty; columns of
    any name are kept.
    """
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with five-word similarity of 0.8 or more the row with the smallest id.

    SimHashes and BK-trees give near copies, compared exactly; prefixes give the pairs that SimHash leaves apart.

    Nulls, ties, repeated rows, empty tables and clashing names as in the stage before.
    """
    return near_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are judged one by one by their texts; null and empty texts hold nothing and stay, as does every row if there
    are no items. An empty table stays empty; columns of any name are kept.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as decoded from their token ids, with n_tokens and ids_sha256 added.

    Null texts become empty ones. Every row stays; columns of those two names are replaced, all others kept.
    """
    return bpe.with_token_count(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding_and_decoding", bpe_stage),
]

#: The stages learn, align and encode: SQL cannot express them. Tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
