"""One summary row per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import numbered_list
from sitegauge.operators.aggregates import value_counts
from sitegauge.operators.ranks import brief_lists

PAIRS_SHOWN = 3
NO_PAIRS = "none found"


def _two_decimals(column: str):
    return F.format_string("%.2f", F.col(column))


def page_type_lines(scores: DataFrame) -> DataFrame:
    """``Blog 3 (12.0%)`` per page type, biggest first."""
    counts = value_counts(scores, "page_type")
    line = F.format_string("%s %d (%.1f%%)", "page_type", "pages", "share")
    entry = F.struct((-F.col("pages")).alias("order"), "page_type", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"])
    return counts.groupBy("site_id").agg(F.array_join(lines, "\n").alias("page_types"))


def pair_lines(pairs: DataFrame) -> DataFrame:
    """Number of similar pairs and the first of them; *pairs* carries ``rank``."""
    shown = F.format_string("%.2f %s ~ %s", "similarity", "url1", "url2")
    entry = F.when(F.col("rank") <= PAIRS_SHOWN, F.struct("rank", shown.alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"])
    return pairs.groupBy("site_id").agg(
        F.concat(
            F.count(F.lit(1)).cast("string"),
            F.lit(" pairs, the closest being\n"),
            F.array_join(lines, "\n"),
        ).alias("similar_pairs")
    )


def site_brief(site_scores: DataFrame, scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores, example pages, page types and similar pairs of every site, with a text that
    holds them all."""
    joined = (
        site_scores.select("site_id", "total", "focus_score", "radius_score")
        .join(brief_lists(scores), "site_id")
        .join(page_type_lines(scores), "site_id")
        .join(pair_lines(pairs), "site_id", "left")
        .select(
            "site_id",
            "total",
            _two_decimals("focus_score").alias("focus_score"),
            _two_decimals("radius_score").alias("radius_score"),
            numbered_list("focused_urls", empty="N/A").alias("focused_pages"),
            numbered_list("divergent_urls", empty="N/A").alias("divergent_pages"),
            "page_types",
            F.coalesce("similar_pairs", F.lit(NO_PAIRS)).alias("similar_pairs"),
        )
    )
    brief = F.concat_ws(
        "\n",
        F.concat(F.lit("Pages: "), F.col("total").cast("string")),
        F.concat(F.lit("Focus score: "), "focus_score", F.lit(" / 100")),
        F.concat(F.lit("Radius score: "), "radius_score", F.lit(" / 100")),
        F.concat(F.lit("Closest to the core theme:\n"), "focused_pages"),
        F.concat(F.lit("Furthest from the core theme:\n"), "divergent_pages"),
        F.concat(F.lit("Page types:\n"), "page_types"),
        F.concat(F.lit("Similar pages:\n"), "similar_pairs"),
    )
    return joined.withColumn("brief", brief)
