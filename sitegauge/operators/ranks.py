"""Per-site rankings; ties are always broken by URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.operators.lookups import attach_by_site
from sitegauge.session import materialize

DISTANCE = "distance_from_centroid"
HIGHLY_FOCUSED_BELOW = 20
HIGHLY_DIVERGENT_ABOVE = 80


def _top(rows: DataFrame, order: list, limit: int, name: str = "rank") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(*order))
    return rows.withColumn(name, rank).filter(F.col(name) <= limit)


def most_focused(scores: DataFrame, limit: int = 10) -> DataFrame:
    return _top(scores, [F.asc(DISTANCE), F.asc("url")], limit)


def most_divergent(scores: DataFrame, limit: int = 10) -> DataFrame:
    return _top(scores, [F.desc(DISTANCE), F.asc("url")], limit)


def brief_lists(scores: DataFrame, limit: int = 5) -> DataFrame:
    """Per site the first and the last *limit* URLs of the ascending distance order."""
    slim = scores.select("site_id", DISTANCE, "url")
    entry = F.struct(DISTANCE, "url")
    urls = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["url"])
    first = _top(slim, [F.asc(DISTANCE), F.asc("url")], limit).groupBy("site_id")
    last = _top(slim, [F.desc(DISTANCE), F.desc("url")], limit).groupBy("site_id")
    return first.agg(urls.alias("focused_urls")).join(
        last.agg(urls.alias("divergent_urls")), "site_id"
    )


def focus_rank(scores: DataFrame) -> DataFrame:
    """Position of every page in its site's distance order, as a percentage.

    A site may be larger than a task, so there is no window over the site: rows are
    range-partitioned by (site, distance, url), numbered inside each partition, and
    shifted by the row counts of the site's earlier partitions. The numbered rows are
    materialised first because the shift must refer to the very same partitions.
    """
    numbered = materialize(
        scores.select("site_id", "url", DISTANCE)
        .repartitionByRange("site_id", DISTANCE, "url")
        .sortWithinPartitions("site_id", DISTANCE, "url")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("row", 33))
    )
    parts = numbered.groupBy("site_id", "part").agg(
        F.min("row").alias("first_row"), F.count(F.lit(1)).alias("rows")
    )
    whole_site = Window.partitionBy("site_id")
    # at most (sites + partitions) rows
    offsets = parts.select(
        "site_id",
        "part",
        (
            F.sum("rows").over(whole_site.orderBy("part")) - F.col("rows") - F.col("first_row")
        ).alias("shift"),
        F.sum("rows").over(whole_site).alias("site_rows"),
    )
    position = F.col("row") + F.col("shift")
    percent = F.when(F.col("site_rows") > 1, position / (F.col("site_rows") - 1) * 100)
    ranked = numbered.join(offsets, ["site_id", "part"]).select(
        "site_id",
        "url",
        DISTANCE,
        (position + 1).alias("position"),
        F.coalesce(percent, F.lit(0.0)).alias("focus_rank"),
    )
    return ranked.withColumn("focus_label", focus_label(F.col("focus_rank")))


def focus_label(percent):
    return F.when(percent < HIGHLY_FOCUSED_BELOW, "Highly Focused").when(
        percent > HIGHLY_DIVERGENT_ABOVE, "Highly Divergent"
    )


#: Sites up to which their bounds are broadcast.
BROADCAST_SITES = 1 << 20


def top_pairs(pairs: DataFrame, limit: int = 20, by: str = "distance", descending: bool = False):
    """First *limit* pairs of each site with the number of all its pairs.

    Pairs are counted by ranges of *by*, and only those up to the end of the range that completes a site's first
    *limit* are ranked: no task sorts all pairs. A range is known by the last value in it, so
    how values are dealt to ranges decides the work, never the result.
    """
    lead, last, end = (F.desc, F.min, F.min) if descending else (F.asc, F.max, F.max)
    value = F.col(by).cast("double")
    dealt = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(value)) * 64)).cast("long")
    ranges = pairs.groupBy("site_id", F.signum(value).alias("sign"), dealt.alias("range")).agg(
        F.count(F.lit(1)).alias("pairs"), last(by).alias("last")
    )
    by_site = Window.partitionBy("site_id").orderBy(lead("last"))
    before = F.coalesce(F.sum("pairs").over(by_site.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = F.when(F.col("before") < limit, F.struct("last"))
    bounds = materialize(
        ranges.withColumn("before", before)
        .groupBy("site_id")
        .agg(
            F.sum("pairs").alias("total_pairs"),
            end(needed["last"]).alias("bound"),
            F.max(needed.isNotNull() & F.col("last").isNull()).alias("blank"),
        )
    )
    inside = (F.col(by) >= F.col("bound")) if descending else (F.col(by) <= F.col("bound"))
    kept = F.coalesce(inside, F.lit(False)) | (F.col(by).isNull() & F.col("blank"))
    few = bounds.count() <= BROADCAST_SITES
    held = pairs.join(F.broadcast(bounds), "site_id") if few else attach_by_site(pairs, bounds)
    best = held.filter(kept).select(*pairs.columns, "total_pairs")
    order = [lead(by), F.asc("url1"), F.asc("url2")]
    return _top(best, order, limit).select(*pairs.columns, "rank", "total_pairs")
