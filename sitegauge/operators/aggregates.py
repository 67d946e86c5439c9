"""Counts, shares, histograms and word statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions import text as T
from sitegauge.operators.lookups import attach_by_site


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column with the percentage share within the site."""
    counts = rows.groupBy("site_id", column).agg(F.count(F.lit(1)).alias("pages"))
    # one row per (site, value) is left here, so the window sees only the small result
    total = F.sum("pages").over(Window.partitionBy("site_id"))
    return counts.withColumn("share", F.round(F.col("pages") / total * 100, 1))


def histogram(rows: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins per site between its smallest and largest value; last bin closed."""
    bounds = rows.groupBy("site_id").agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    raw_bin = F.when(width > 0, F.floor((F.col(column) - F.col("low")) / width)).otherwise(0)
    binned = attach_by_site(rows.select("site_id", column), bounds).select(
        "site_id", "low", width.alias("width"), F.least(raw_bin, F.lit(bins - 1)).alias("bin")
    )
    return binned.groupBy("site_id", "bin").agg(
        F.count(F.lit(1)).alias("pages"),
        F.min(F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        F.min(F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
    )


def extraction_stats(page_text: DataFrame, column: str = "raw_text") -> DataFrame:
    length = F.length(F.coalesce(F.col(column), F.lit("")))
    return page_text.groupBy("site_id").agg(
        F.avg(length).alias("mean_length"), F.count_if(length == 0).alias("empty_texts")
    )


def word_frequency(
    page_text: DataFrame,
    keys: tuple[str, ...] = ("site_id", "url"),
    limit: int = 20,
    column: str = "processed_text",
) -> DataFrame:
    """Most frequent words of two or more letters per key, ties in word order."""
    words = page_text.select(*keys, F.explode(T.split_words(column)).alias("word"))
    counts = (
        words.filter(F.length("word") > 1)
        .groupBy(*keys, "word")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    rank = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.desc("frequency"), F.asc("word"))
    )
    return counts.withColumn("rank", rank).filter(F.col("rank") <= limit)


def lexical_stats(page_text: DataFrame, column: str = "processed_text") -> DataFrame:
    return page_text.select(
        "site_id",
        "url",
        T.word_count(column).alias("word_count"),
        T.unique_words(column).alias("unique_words"),
        T.lexical_diversity(column).alias("lexical_diversity"),
    )
