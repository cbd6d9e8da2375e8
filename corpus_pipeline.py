"""From raw documents to packed sequences: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the columns
of documents. Near-duplicates are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more,
and those that such links connect; the one with the smallest doc_id stays.

A stage bounds the bytes of an Arrow batch in the session that docs come from; that setting stays, as the rows that a stage
returns are made only when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import ngram_join, packing, quality_rules, toxicity
from sievework.llm.queries import vocabulary
from sievework.llm.shared import Workspace, bound_batches, own_session, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject. A null text has no words and goes; repeated rows stay or go together; values at a cutoff stay."""
    bound_batches(docs.sparkSession)
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is scored as toxic. A null or empty text has the score of the bias and stays; repeated rows stay or go together; a score at the threshold goes."""
    bound_batches(docs.sparkSession)
    return toxicity.passing(docs, table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id (a null one last); of repeated rows one. Texts without words all stay."""
    bound_batches(docs.sparkSession)
    return ngram_join.one_of_each(docs, n=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of 4096 tokens. A null text is the end token alone; each of repeated rows is packed."""
    bound_batches(docs.sparkSession)
    return packing.pack(docs, vocabulary())


STAGES = [("quality_rules", good), ("toxicity", civil), ("ngram_join", unlike), ("packing", packed)]

#: The thresholds, the classifier and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over a table that its predecessor wrote; in a session of its own, with bounded batches."""
    spark = own_session(spark)
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark, "pipeline") as work:
        for name, stage in STAGES[:-1]:
            docs = work.written(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return written(stage(spark, docs, sf_dir), name)
