"""A corpus-cleaning pipeline: toxicity, near duplicates, benchmark decontamination, tokenisation.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet into the shared folder and reads again for the next. All but the last return the columns of documents.

Null texts count as empty ones and, like texts without words, stay to the end. Of repeated rows, and of rows with equal
texts, one stays; rows with a null doc_id are chosen from by themselves. Other columns, whatever their names, stay until the
last stage, which replaces the text and columns named n_tokens and ids. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import bpe, decontaminate, jaccard_join, toxicity
from siftwell.llm.common import discard, materialise, table, work_dir


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; learnt from the labelled ones among them."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group linked by 5-word shingles at a similarity of 0.8."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens and ids (little-endian unsigned 32-bit) instead of their text."""
    codec = bpe.Codec.from_file(public_tokenizers.path(bpe.VOCABULARY))
    return bpe.encode(docs, codec)


STAGES = [("toxicity", toxic), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminated), ("byte_bpe", tokenised)]

#: A boosted model, a tokenizer and exact set joins over whole texts are beyond SQL here; tests compare stages with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        at = work_dir(spark)
        docs = materialise(stage(spark, docs, sf_dir), at)
        if last:  # what the stage before wrote; never the input
            discard(spark, last)
        last = at
    return docs
