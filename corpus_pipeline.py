"""From raw documents to token files: quality, near duplicates, benchmark passages, source weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads, all but the last with the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from headwind.llm.decontaminate import decontaminate
from headwind.llm.jaccard import one_of_each_class
from headwind.llm.mixing import repeat_by_mix
from headwind.llm.quality import keep_good
from headwind.llm.tokenfiles import read_token_files, write_token_files
from headwind.session import made, materialize, release

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null or empty text is judged as a text without words; repeated rows stay or go together; an empty table stays
    empty, and without labels every row stays.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the row with the least doc_id, null first, then the least hash of the text.

    Of rows alike in doc_id and text one stays; rows without words are alike only then. An empty table stays empty.
    """
    return one_of_each_class(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not leak benchmark items: neither 13 consecutive words of one, nor short ones in a twentieth of their words.

    A null or empty text leaks nothing; repeated rows stay or go together; an empty benchmark removes nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, twice at most.

    A null source is a source of its own; a source without words is not taken; repeated rows are each drawn; an empty
    table stays empty.
    """
    return repeat_by_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and each document's place in them, in ascending order of doc_id, null first.

    A null or empty text has the end id alone; repeated rows follow one another; no rows give files without documents.
    """
    return read_token_files(spark, write_token_files(docs, TOKENIZER))


STAGES = [("quality", quality), ("near_duplicates", deduplicate), ("decontamination", remove_benchmark), ("mixing", mix), ("tokens", tokenize)]

#: A trained classifier, a drawn sample and a tokenizer are beyond SQL; tests/llm holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again, and what it made on the way is deleted."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
