"""Pages that arrive in a folder, as article records, and running term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.functions.text import full_text, tokens
from lutrin.sources.files import articles_of


def stream_articles(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of article records of the *.htm files of a folder, old ones first, then each that arrives."""
    pages = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.htm").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return articles_of(pages.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")))


def first_once(articles: DataFrame, time_col: str = "ingested_at", key: str = "article", delay: str = "30 days") -> DataFrame:
    """A stream without articles collected again: the first of each key within ``delay`` of the watermark passes.

    State is kept for as long as the delay, so it doesn't grow with the stream.
    """
    return articles.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def running_term_counts(articles: DataFrame) -> DataFrame:
    """(term, n): counts of terms over all that has arrived; for output mode complete or update."""
    return articles.select(F.explode(tokens(full_text())).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def monthly_term_counts(articles: DataFrame, time_col: str = "ingested_at", delay: str = "90 days", width: str = "30 days") -> DataFrame:
    """(begin, term, n) of windows of event time; rows later than ``delay`` are left out, closed windows can be appended."""
    rows = articles.withWatermark(time_col, delay).select(time_col, F.explode(tokens(full_text())).alias("term"))
    return rows.groupBy(F.window(time_col, width), "term").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "term", "n")
