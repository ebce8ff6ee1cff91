"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the columns of
`documents` (others go); the last one returns the pieces of packed sequences. Between stages the rows are a Parquet
table, which goes once the next one is written. The input needs the five columns of `documents`. Ids may be null or repeat: each row has a decision of its own. An empty table gives no rows at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgrid.llm.common import discard, keyed, written
from hitgrid.llm.language_id import host_suffix, identify
from hitgrid.llm.line_dedup import drop_frequent_lines
from hitgrid.llm.ngram_jaccard import jaccard_components
from hitgrid.llm.packing import pack_documents
from hitgrid.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """documents with a row_key: ids may be null or repeat, and each row has a decision of its own."""
    return keyed(docs, "doc_id", *COLUMNS[1:])[0]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that language identification rejects go: too short for a decision, unsure, or in no language of the corpus.

    The language found replaces the declared one only in the decision. Rows are judged one by one, whatever their ids are.
    """
    rows = _keyed(docs)
    judged = identify(rows, declared=F.col("lang"), host=F.col("source"), suffix=host_suffix(F.col("source")), key_col="row_key")
    return rows.join(judged.filter(~F.col("accepted")).select("row_key"), "row_key", "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten documents or more lose all their copies; every row stays, null texts as empty ones."""
    return _documents(drop_frequent_lines(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id stays, of several such rows one."""
    rows = _keyed(docs)
    judged = jaccard_components(rows, key_col="row_key")
    return rows.join(judged.filter(~F.col("kept")).select("row_key"), "row_key", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 51 words that stand earlier go; every row stays, null texts as empty ones."""
    return _documents(dedup_substrings(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1,024 tokens that hold all texts."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL can't express the fitted language model, the rolling hash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # of the stage before; the input is no table of ours
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
