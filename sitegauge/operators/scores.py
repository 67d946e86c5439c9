"""Centroids, distances from them, focus and radius scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import text as T
from sitegauge.functions import urls as U
from sitegauge.functions import vectors as V
from sitegauge.operators import pairs as P
from sitegauge.operators import profile
from sitegauge.operators.lookups import attach_by_site

# Both sensitivity factors are relative to this default.
DEFAULT_K = 5.0
DISTANCE = "distance_from_centroid"


# --- planar scores ------------------------------------------------------------------------


def centroid_2d(points: DataFrame) -> DataFrame:
    return points.groupBy("site_id").agg(
        F.avg(F.col("x").cast("double")).alias("centroid_x"),
        F.avg(F.col("y").cast("double")).alias("centroid_y"),
    )


def planar_distances(points: DataFrame) -> DataFrame:
    dx, dy = F.col("x") - F.col("centroid_x"), F.col("y") - F.col("centroid_y")
    return (
        attach_by_site(points, centroid_2d(points))
        .withColumn(DISTANCE, F.sqrt(dx * dx + dy * dy))
        .drop("centroid_x", "centroid_y")
    )


def page_scores(points: DataFrame) -> DataFrame:
    """The result table: one row per page with path words, type, depth and distance."""
    return planar_distances(points).select(
        "site_id",
        "url",
        U.process_url_path("url").alias("processed_path"),
        U.page_type("url").alias("page_type"),
        U.page_depth("url").alias("page_depth"),
        "x",
        "y",
        DISTANCE,
    )


def with_previews(scores: DataFrame, page_text: DataFrame, sources: DataFrame) -> DataFrame:
    """Content preview and source sitemap beside each scored page."""
    from sitegauge.operators.lookups import page_lookup, with_source

    shown = page_lookup(scores, page_text, ["processed_text"], {"processed_text": ""})
    shown = shown.withColumn("content_preview", T.preview("processed_text", 200))
    return with_source(shown.drop("processed_text"), sources)


def _spread(distances: DataFrame) -> DataFrame:
    return distances.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(DISTANCE).alias("mean_distance"),
        F.max(DISTANCE).alias("max_distance"),
    )


def focus_score(mean: Column, largest: Column, k1: float = DEFAULT_K) -> Column:
    """100 for a point-like site, falling with the mean distance relative to the largest."""
    ratio = V.clamp(mean / (largest + V.EPSILON), 0.0, 1.0)
    score = 100 * F.pow(1 - ratio, F.lit(k1 / DEFAULT_K))
    return F.when(largest < V.EPSILON, 100.0).otherwise(V.clamp(score, 0.0, 100.0))


def _radius(largest: Column, diameter: Column, k2: float) -> Column:
    ratio = largest / (diameter + V.EPSILON)
    return V.clamp(100 * (1 - F.exp(-ratio * (k2 / DEFAULT_K))), 0.0, 100.0)


def radius_score_2d(largest: Column, diameter: Column, k2: float = DEFAULT_K) -> Column:
    return F.when(diameter < V.EPSILON, 0.0).otherwise(_radius(largest, diameter, k2))


def planar_site_scores(
    points: DataFrame, k1: float = DEFAULT_K, k2: float = DEFAULT_K
) -> DataFrame:
    """Focus and radius of every site from planar coordinates."""
    spread = _spread(planar_distances(points))
    return spread.join(P.diameter_2d(points), "site_id").select(
        "site_id",
        "total",
        "mean_distance",
        "max_distance",
        "diameter",
        focus_score(F.col("mean_distance"), F.col("max_distance"), k1).alias("focus_score"),
        radius_score_2d(F.col("max_distance"), F.col("diameter"), k2).alias("radius_score"),
    )


# --- vector scores ------------------------------------------------------------------------


def centroid_nd(vectors: DataFrame) -> DataFrame:
    """Mean vector per site, then scaled to length one (the pages' vectors are not)."""
    return P.mean_vectors(vectors).select("site_id", "total", V.unit("mean").alias("centroid"))


def cosine_distances(vectors: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """Cosine distance of every page from its site's centroid."""
    middle = (centroids or centroid_nd(vectors)).select("site_id", "centroid")
    lengths = V.norm("embedding") * V.norm("centroid")
    similarity = F.when(lengths > 0, V.dot("embedding", "centroid") / lengths).otherwise(0.0)
    return attach_by_site(vectors, middle).select(
        "site_id", "url", V.clamp(1 - similarity, 0.0, 2.0).alias(DISTANCE)
    )


def radius_score_cosine(largest: Column, diameter: Column, k2: float = DEFAULT_K) -> Column:
    identical = F.when(largest < V.EPSILON, 0.0).otherwise(100.0)
    ratio = V.clamp(largest / (diameter + V.EPSILON), 0.0, 1.0)
    score = V.clamp(100 * (1 - F.exp(-ratio * (k2 / DEFAULT_K))), 0.0, 100.0)
    return F.when(diameter < V.EPSILON, identical).otherwise(score)


def vector_site_scores(
    vectors: DataFrame,
    dimensions: int,
    k1: float = DEFAULT_K,
    k2: float = DEFAULT_K,
    group_rows: int | None = None,
) -> DataFrame:
    """Focus, radius and centroid of every site from its page vectors."""
    return _scored(profile.site_spans(vectors, dimensions, group_rows), k1, k2)


def _scored(sites: DataFrame, k1: float, k2: float, *more: str) -> DataFrame:
    return sites.select(
        "site_id",
        "total",
        "mean_distance",
        "max_distance",
        "diameter",
        "centroid",
        focus_score(F.col("mean_distance"), F.col("max_distance"), k1).alias("focus_score"),
        radius_score_cosine(F.col("max_distance"), F.col("diameter"), k2).alias("radius_score"),
        *more,
    )


def project_results(
    vectors: DataFrame,
    dimensions: int,
    k1: float = DEFAULT_K,
    k2: float = DEFAULT_K,
    max_distance: float = P.CANNIBAL_DISTANCE,
    limit: int = P.CANNIBAL_LIMIT,
    group_rows: int | None = None,
) -> DataFrame:
    """One row per site: scores, page count, centroid and its most similar pairs, by one pass over the cells."""
    usable = P.usable_vectors(vectors, dimensions)
    found = profile.site_spans_and_pairs(usable, dimensions, max_distance, limit, group_rows)
    return _scored(found, k1, k2, "pairs")
