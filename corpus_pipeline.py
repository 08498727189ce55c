"""From raw documents to a training mix.  Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; all but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns, which it
passes on: a row with a null doc_id or text is neither toxic by itself, nor a copy, nor contaminated, so it stays; of
copies that tie the smallest doc_id stays; repeated rows of a doc_id share their fate; an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import decontaminate, linedup, mixing, neardup, toxicity
from threadmill.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; every document stays, if need be with empty text."""
    return linedup.without_lines(docs, linedup.removed_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, 0.8) stays."""
    again = neardup.near_duplicates(docs, k=5, percent=80).filter("not kept").select(F.col("doc_id").alias("again_id")).distinct()
    return docs.join(again, docs["doc_id"] == again["again_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id"))
    return docs.join(found, docs["doc_id"] == found["found_id"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix to target weights takes of each document."""
    return mixing.taken(mixing.mix_sources(docs, weights=[1.0, 2.0, 3.0]))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix)]

#: No stage but the near duplicates can be expressed in SQL in full; tests/llm/test_pipeline_stages.py holds line dedup, near
#: dedup and decontamination against brute force, mixing against its targets, and toxicity against the chain's own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
