"""A corpus pipeline: toxicity, line dedup, near-dedup, substring dedup, best-fit packing.

Each stage works on all that the stage before has kept; all but the last return the columns of documents, with text
and n_chars as the stage leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read, stored
from tidemark.llm.lines import dedup_lines
from tidemark.llm.packing import default_tokenizer, pack_documents
from tidemark.llm.simhash import keep_one
from tidemark.llm.substring import drop_repeats
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those that the toxicity model, learnt from the labels table, scores 0.7 or more; null and empty texts stay.

    Repeated rows are judged alike, by their text; columns are kept, whatever their names.
    """
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with lines removed that are similar to an earlier one; null texts stay null, an emptied text stays as ''."""
    return dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of similar texts, that of the least doc_id; rows without a doc_id stay.

    Similar are five-word shingle sets at 0.8 or more: groups of SimHash fingerprints within two bits, verified by the
    sets, and what an exact join of the sets finds beyond that radius. Rows that share a doc_id stay or go together; null and empty texts are one group.
    """
    return keep_one(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without words of windows of 50 that start in a document of smaller doc_id too; what is left is joined by blanks."""
    return drop_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document and its place in a sequence of 2048 tokens; null and empty texts are one token."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Most stages can't be put into SQL; tests hold the rules of line dedup, near-dedup, substring dedup and packing against
#: brute-force versions, and toxicity by its held-out documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
