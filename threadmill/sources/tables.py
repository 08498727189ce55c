"""The parquet test tables, and the message stream that conversations make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as the normalized message stream; a system turn is injected."""
    t = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    return t.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), none.alias("thinking"),
        F.array().cast("array<string>").alias("tool_calls_summary"), none.alias("timestamp"), (F.col("role") == "system").alias("injected"),
    )
