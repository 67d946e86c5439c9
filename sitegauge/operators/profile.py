"""Everything that a site's row needs from its page vectors, by few readings of them.

Site values (page count, centroid, distances from it) are attached to the pages by one shuffled join. One
vector of every site, that of the least hash, carries them on through the cells as a header, so
that they come out beside the cells' maxima and best pairs: no part of the plan is joined back
and thus computed twice.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions import vectors as V
from sitegauge.operators import blocks as B
from sitegauge.operators import pairs as P
from sitegauge.operators.lookups import attach_by_site

_HEADER = "total bigint, mean_distance double, max_distance double, has_zero boolean, centroid array<double>"
_VALUES = ("total", "mean_distance", "max_distance", "has_zero", "centroid")
_ARROW = pa.struct(
    [("total", pa.int64()), ("mean_distance", pa.float64()), ("max_distance", pa.float64()), ("has_zero", pa.bool_())]
    + [pa.field("centroid", pa.list_(pa.field("element", pa.float64())))]
)
_TYPE = f"struct<{_HEADER.replace(' ', ':').replace(',:', ',')}>"
# classes of a cell's output rows
_APART, _COPIES, _WIDEST, _SITE = range(4)


def _cosine(a: str, b: str) -> Column:
    """Of two vectors; 0 if one of them is zero."""
    return F.coalesce(F.try_divide(V.dot(a, b), V.norm(a) * V.norm(b)), F.lit(0.0))


def _angle(cosine: Column) -> Column:
    return F.acos(V.clamp(cosine, -1.0, 1.0))


def _site_values(vectors: DataFrame, *more: Column) -> DataFrame:
    """Per site: page count, centroid, distances from it, whether a vector is zero, the least hash of a vector.

    The centroid is part of the grouping key: a first() of an array would need sorted rows.
    """
    middle = P.mean_vectors(vectors).select("site_id", "total", V.unit("mean").alias("centroid"))
    pages = attach_by_site(vectors, middle).withColumn("cosine", _cosine("embedding", "centroid"))
    away = V.clamp(1 - F.col("cosine"), 0.0, 2.0)
    return pages.groupBy("site_id", "total", "centroid").agg(
        F.avg(away).alias("mean_distance"),
        F.max(away).alias("max_distance"),
        F.max(V.norm("embedding") == 0).alias("has_zero"),
        F.min(F.xxhash64("embedding")).alias("lead"),
        *more,
    )


def _headed(sized_by: str, size: int) -> tuple[Column, Column]:
    """Header of the leading vector's row, number of groups."""
    lead = F.xxhash64("embedding") == F.col("lead")
    return F.when(lead, F.struct(*_VALUES)).alias("header"), F.ceil(F.col(sized_by) / size).cast("int").alias("groups")


def _head(table: pa.Table) -> pa.Array:
    """The header of a diagonal cell, or nothing."""
    header = table.column("header").combine_chunks()
    header = pa.concat_arrays(header.chunks) if isinstance(header, pa.ChunkedArray) else header
    return (header if B.is_diagonal(table) else header.slice(0, 0)).drop_null().slice(0, 1).cast(_ARROW)


def _floor(diameter: str) -> Column:
    """The zero vector is at distance one from every page, copies of it included."""
    return F.greatest(diameter, F.when(F.col("has_zero") & (F.col("total") > 1), 1.0).otherwise(0.0))


def _span_kernel(table: pa.Table) -> pa.Table:
    values = B.unit_rows(B.matrix(table, "embedding"))
    widest = 0.0
    for _, _, distance, mask in B.tiles(table, values, B.cosine):
        widest = max(widest, float(distance.max(initial=0.0, where=True if mask is None else mask)))
    head = _head(table)
    return pa.table(
        {
            "site_id": B.key_columns(table, 1),
            "diameter": pa.array([widest], pa.float64()),
            "header": head if len(head) else pa.nulls(1, head.type),
        }
    )


def site_spans(vectors: DataFrame, dimensions: int, group_rows: int | None = None) -> DataFrame:
    """Per site: total, mean_distance, max_distance, centroid, diameter.

    In sites of more than one cell, pages that cannot belong to the widest pair are dropped by angles
    before the cells; exact. With c the centroid, no pair of v opens wider than angle(v, c) + the widest
    angle to c, and a sweep from the page farthest from c gives a true lower bound of the widest pair.
    """
    size = group_rows or B.rows_per_group(dimensions)
    is_zero, angle = V.norm("embedding") == 0, _angle(F.col("cosine"))
    opened = F.when(~is_zero, angle)
    far = F.max_by("embedding", F.when(F.col("total") > size, F.coalesce(opened, F.lit(-1.0))))
    sites = _site_values(vectors, F.max(opened).alias("widest"), far.alias("far"))
    site = F.struct(*_VALUES, "lead", "widest", "far").alias("site")
    swept = _angle(_cosine("embedding", "site.far"))
    reach = F.max(F.when(F.col("site.far").isNotNull() & ~is_zero, swept)).alias("reach")
    bounds = attach_by_site(vectors, sites.select("site_id", site)).groupBy("site_id", "site").agg(reach)
    rows = attach_by_site(vectors, bounds.select("site_id", "site.*", "reach"))
    able = _angle(_cosine("embedding", "centroid")) + F.col("widest") >= F.col("reach") - 1e-6
    leads = F.xxhash64("embedding") == F.col("lead")
    kept = rows.filter(F.coalesce(able, F.lit(True)) | leads)
    distinct = kept.select("site_id", "embedding", *_headed("total", size)).distinct()
    cells = B.copy_to_cells(distinct.withColumn("rep", F.xxhash64("embedding")), "rep")
    found = B.run_cells(cells, _span_kernel, f"site_id string, diameter double, header {_TYPE}")
    whole = found.groupBy("site_id").agg(F.max("diameter").alias("diameter"), F.first("header", ignorenulls=True).alias("header"))
    return whole.select("site_id", "header.*", "diameter").withColumn("diameter", _floor("diameter"))


def _both_kernel(max_distance: float, limit: int):
    def kernel(table: pa.Table) -> pa.Table:
        pairs, widest = P.cell_top_pairs(table, max_distance, limit)
        first, second = pairs.column("urls1").to_pylist(), pairs.column("urls2").to_pylist()
        kinds = [_COPIES if a[0] == b[0] else _APART for a, b in zip(first, second)]
        head = _head(table)
        rest = 1 + len(head)
        count = len(kinds) + rest
        return pa.table(
            {
                "site_id": B.key_columns(table, count),
                "kind": pa.array([*kinds, _WIDEST, *[_SITE] * len(head)], pa.int32()),
                "urls1": pa.array([*first, *[None] * rest], pa.list_(pa.string())),
                "urls2": pa.array([*second, *[None] * rest], pa.list_(pa.string())),
                "value": pa.array([*pairs.column("similarity").to_pylist(), widest, *[0.0] * len(head)], pa.float64()),
                "header": pa.concat_arrays([pa.nulls(count - len(head), head.type), head]),
            }
        )

    return kernel


def site_spans_and_pairs(
    vectors: DataFrame,
    dimensions: int,
    max_distance: float = P.CANNIBAL_DISTANCE,
    limit: int = P.CANNIBAL_LIMIT,
    group_rows: int | None = None,
) -> DataFrame:
    """:func:`site_spans` and the site's ``pairs`` (url1, url2, similarity; best first), as :func:`pairs.cannibalization` has them.

    The search for pairs compares all distinct vectors of a site anyway, so the widest pair comes from the same cells.
    """
    size = group_rows or B.rows_per_group(dimensions)
    groups = attach_by_site(P.listed_copies(vectors, limit + 1), _site_values(vectors))
    cells = B.copy_to_cells(groups.select("site_id", "rep", "urls", "embedding", *_headed("total", size)), "rep")
    schema = f"site_id string, kind int, urls1 array<string>, urls2 array<string>, value double, header {_TYPE}"
    found = B.run_cells(cells, _both_kernel(max_distance, limit), schema)
    # each class is ranked apart, and pruned before the shuffle: of maxima and headers one row a site is left
    closeness = F.round("value", P.RANK_DIGITS).desc()
    lead = [closeness, F.asc(F.col("urls1")[0]), F.asc(F.col("urls2")[0]), F.desc("value")]
    rank = F.row_number().over(Window.partitionBy("site_id", "kind").orderBy(*lead))
    is_pair = F.col("kind") <= _COPIES
    pages = (
        found.withColumn("rank", rank)
        .filter(F.col("rank") <= F.when(is_pair, limit).otherwise(1))
        .filter(F.col("rank") <= limit)
        .withColumn("a", F.explode_outer("urls1"))
        .withColumn("b", F.explode_outer("urls2"))
        .filter((F.col("kind") != _COPIES) | (F.col("a") < F.col("b")))
        .withColumns({"url1": F.least("a", "b"), "url2": F.greatest("a", "b")})
        .withColumn("class", F.when(is_pair, F.lit(_APART)).otherwise(F.col("kind")))
        .select("site_id", "class", "url1", "url2", "value", "header")
    )
    place = F.row_number().over(Window.partitionBy("site_id", "class").orderBy(closeness, "url1", "url2"))
    entry = F.struct("place", "url1", "url2", F.col("value").alias("similarity"))
    # at most *limit* pairs and two more rows a site
    whole = (
        pages.withColumn("place", place)
        .filter(F.col("place") <= limit)
        .groupBy("site_id")
        .agg(
            F.max(F.when(F.col("class") == _WIDEST, F.col("value"))).alias("diameter"),
            F.first("header", ignorenulls=True).alias("header"),
            F.array_sort(F.collect_list(F.when(F.col("class") == _APART, entry))).alias("pairs"),
        )
    )
    listed = F.transform("pairs", lambda e: F.struct(e["url1"].alias("url1"), e["url2"].alias("url2"), e["similarity"].alias("similarity")))
    return whole.select("site_id", "header.*", "diameter", listed.alias("pairs")).withColumn("diameter", _floor("diameter"))
