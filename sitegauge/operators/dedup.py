"""URL list merging, capping and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_sitemap_urls(listed: DataFrame) -> DataFrame:
    """One row per (site, url): first position kept, last listing sitemap as source.

    *listed* has ``site_id, url, sitemap, position``; sitemaps are ordered by URL, so the
    position within the site is the pair (sitemap, position).
    """
    order = F.struct("sitemap", "position")
    return (
        listed.groupBy("site_id", "url")
        .agg(F.min(order).alias("first_seen"), F.max("sitemap").alias("source_sitemap"))
        .select("site_id", "url", "source_sitemap", "first_seen")
    )


def cap_urls(urls: DataFrame, limit: int = 100, order: str = "first_seen") -> DataFrame:
    """First *limit* URLs of each site; the rank filter prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(order, "url"))
    return urls.withColumn("seq", rank).filter(F.col("seq") <= limit)


def sort_by_distance(scores: DataFrame) -> DataFrame:
    return scores.orderBy("distance_from_centroid", "url")


def facet_values(scores: DataFrame, column: str) -> DataFrame:
    """Distinct values offered by a filter box."""
    return scores.select("site_id", column).distinct().orderBy("site_id", column)
