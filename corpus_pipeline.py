"""The documents table as training data: rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame that is written and read again
as the next one's docs. All but the last return the columns of documents. Nulls, empty and very long texts, repeated rows
and extra columns are handled as the stages' operators say; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, jaccard_join, line_dedup, quality_rules, tree_bpe
from sparkloom.llm.shared import stage, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, near-equal lines cut out but for the first; n_chars counted anew."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids as little-endian unsigned 32-bit integers."""
    return tree_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [("quality rules", rules), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("BPE encoding", tokens)]
#: Alignment, edit distance and BPE are not for SQL. tests/llm checks the columns of each stage, that no linked pair and no leaked text is left, and the count of rows;
#: each stage is held against brute force by the tests of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage{k}")
    return docs
