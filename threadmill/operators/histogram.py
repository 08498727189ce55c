"""Line histograms of texts and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, BAR = 10, 40


def line_histogram(texts: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket, lines, bytes): lines fall into `buckets` by place, the rest of the division into the last; texts of
    no more lines than buckets have a bucket per line.  An empty piece after a last newline is no line."""
    lines = F.split(text, "\n", -1)
    lines = F.when(F.col(text).endswith("\n"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    sized = texts.select(key, F.transform(lines, lambda x: F.octet_length(x)).alias("b"))
    flat = sized.select(key, F.size("b").alias("n"), F.posexplode_outer("b").alias("pos", "bytes")).filter("bytes is not null")
    step = F.floor(F.col("n") / buckets)
    bucket = F.when(F.col("n") <= buckets, F.col("pos") + 1).otherwise(F.least(F.lit(buckets), F.floor(F.col("pos") / step) + 1))
    return flat.groupBy(key, bucket.cast("int").alias("bucket")).agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"))


def with_bars(histogram: DataFrame, key: str, width: int = BAR) -> DataFrame:
    """A bar of `width` characters for the largest bucket, others in proportion."""
    most = histogram.groupBy(key).agg(F.max("bytes").alias("most"))
    return histogram.join(most, key).withColumn("bar", F.repeat(F.lit("#"), F.when(F.col("most") > 0, F.floor(F.col("bytes") * width / F.col("most"))).otherwise(0).cast("int"))).drop("most")


def lines_between(texts: DataFrame, key: str, text: str, start: int, end: int) -> DataFrame:
    """Lines start..end (1-based, both included) of each text."""
    if not 1 <= start <= end:
        raise ValueError("line range must be 1 <= start <= end")
    return texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).filter(F.col("pos").between(start - 1, end - 1)).select(key, (F.col("pos") + 1).alias("line_number"), "line")
