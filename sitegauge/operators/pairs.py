"""Pair operators: distances, diameters, near-duplicates, nearest neighbours.

Equal vectors are collapsed before any pair is formed: a third of all rows being copies
of one page must not cost a square. Distances are ranked after rounding to nine digits,
so that the last bits of a matrix product never decide a tie; ties go by URL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sitegauge.functions import vectors as V
from sitegauge.functions.urls import process_url_path
from sitegauge.operators import blocks as B
from sitegauge.operators import sparse as SP
from sitegauge.operators.lookups import attach, attach_by_site, with_source
from sitegauge.session import stored

IDENTICAL = 1e-9
NEAR_ZERO = 1e-6
RANK_DIGITS = 9
CANNIBAL_DISTANCE = 0.10
CANNIBAL_LIMIT = 50


# --- vectors and their copies ------------------------------------------------------------


def usable_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Rows with a vector of the right length and finite values, in double precision."""
    return vectors.filter(V.is_usable("embedding", dimensions)).select(
        "site_id", "url", V.as_double("embedding").alias("embedding")
    )


def rejected_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    bad = (~V.is_usable("embedding", dimensions)).cast("int")
    return vectors.groupBy("site_id").agg(F.sum(bad).alias("rejected"))


def plane_vectors(points: DataFrame) -> DataFrame:
    """Two-dimensional points in the shape of vectors."""
    return points.select(
        "site_id", "url", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("embedding")
    )


def _hashed(vectors: DataFrame) -> DataFrame:
    # the hash leads the key: comparing whole arrays happens between equal hashes only
    return vectors.withColumn("h", F.xxhash64("embedding"))


def weighted_copies(vectors: DataFrame) -> DataFrame:
    """Distinct vectors per site with the number of pages that have them."""
    return (
        _hashed(vectors)
        .groupBy("site_id", "h", "embedding")
        .agg(F.min("url").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .drop("h")
    )


def listed_copies(vectors: DataFrame, limit: int) -> DataFrame:
    """Distinct vectors per site with the first *limit* URLs that have them.

    The rank filter prunes before the shuffle, so a hot group never gathers.
    """
    key = ["site_id", "h", "embedding"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("url"))
    return (
        _hashed(vectors)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= limit)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list("url")).alias("urls"))
        .select("site_id", F.col("urls")[0].alias("rep"), "urls", "embedding")
    )


def _cells(rows: DataFrame, vectors: DataFrame, dimensions: int, group_rows: int | None):
    # group numbers come from the page count: an upper bound that needs no second pass
    # over the collapsed vectors
    size = group_rows or B.rows_per_group(dimensions)
    return B.to_cells(rows, B.site_groups(vectors, size), "rep")


# --- E1, E3, F14: every pair visited, reductions returned ---------------------------------

_STATS = (
    "site_id string, pairs bigint, far_pairs bigint, far_sum double, far_min double, "
    "max_distance double, near_pairs bigint"
)


def _stats_kernel(metric: str):
    measure = B.euclidean if metric == "euclid" else B.cosine

    def kernel(table: pa.Table) -> pa.Table:
        values = B.matrix(table, "embedding")
        weight = table.column("copies").to_numpy().astype(float)
        zero = np.zeros(len(table), bool)
        if metric == "cosine":
            values = B.unit_rows(values)
            zero = ~values.any(axis=1)
        pairs = far = far_sum = near = 0.0
        low, high = np.inf, 0.0
        if B.is_diagonal(table):
            # copies of one page; copies of the zero vector are at cosine distance one
            inner = weight * (weight - 1) / 2
            pairs += inner.sum()
            near += inner[~zero].sum()
            lone = inner[zero].sum()
            if lone:
                far, far_sum, low, high = far + lone, far_sum + lone, 1.0, 1.0
        for rows, columns, distance, mask in B.tiles(table, values, measure):
            both = weight[rows][:, None] * weight[columns][None, :]
            use = np.ones_like(distance, bool) if mask is None else mask
            if not use.any():
                continue
            away = use & (distance > NEAR_ZERO)
            pairs += both[use].sum()
            near += both[use & ~away].sum()
            far += both[away].sum()
            far_sum += (both * distance)[away].sum()
            if away.any():
                low = min(low, distance[away].min())
            high = max(high, distance[use].max())
        return pa.table(
            {
                "site_id": B.key_columns(table, 1),
                "pairs": pa.array([int(pairs)], pa.int64()),
                "far_pairs": pa.array([int(far)], pa.int64()),
                "far_sum": pa.array([far_sum], pa.float64()),
                "far_min": pa.array([low if far else None], pa.float64()),
                "max_distance": pa.array([high], pa.float64()),
                "near_pairs": pa.array([int(near)], pa.int64()),
            }
        )

    return kernel


def pair_distance_stats(
    vectors: DataFrame, dimensions: int, metric: str = "euclid", group_rows: int | None = None
) -> DataFrame:
    """Statistics of the full distance matrix of every site.

    ``near_zero`` counts entries of the square matrix: both directions and the diagonal.
    """
    cells = _cells(weighted_copies(vectors), vectors, dimensions, group_rows)
    partial = B.run_cells(cells, _stats_kernel(metric), _STATS)
    totals = partial.groupBy("site_id").agg(
        F.sum("pairs").alias("pairs"),
        F.min("far_min").alias("min_distance"),
        F.try_divide(F.sum("far_sum"), F.sum("far_pairs")).alias("mean_distance"),
        F.max("max_distance").alias("max_distance"),
        F.sum("near_pairs").alias("near_pairs"),
    )
    # n pages have n(n-1)/2 pairs: the diagonal follows from the pair count
    pages = F.round((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("bigint")
    return totals.select(
        "site_id",
        "pairs",
        "min_distance",
        "mean_distance",
        "max_distance",
        (2 * F.col("near_pairs") + pages).alias("near_zero"),
    )


def _histogram_kernel(metric: str, bins: int):
    measure = B.euclidean if metric == "euclid" else B.cosine

    def kernel(table: pa.Table) -> pa.Table:
        values = B.matrix(table, "embedding")
        weight = table.column("copies").to_numpy().astype(float)
        low = table.column("min_distance")[0].as_py()
        high = table.column("max_distance")[0].as_py()
        if metric == "cosine":
            values = B.unit_rows(values)
        width = (high - low) / bins
        counts = np.zeros(bins)

        def add(distance: np.ndarray, amount: np.ndarray) -> None:
            place = np.zeros(len(distance), np.int64)
            if width > 0:
                place = np.clip(np.floor((distance - low) / width), 0, bins - 1).astype(np.int64)
            counts[:] += np.bincount(place, weights=amount, minlength=bins)

        if metric == "cosine" and B.is_diagonal(table):
            inner = (weight * (weight - 1) / 2)[~values.any(axis=1)]
            add(np.ones(len(inner)), inner)
        for rows, columns, distance, mask in B.tiles(table, values, measure):
            away = distance > NEAR_ZERO
            if mask is not None:
                away &= mask
            both = weight[rows][:, None] * weight[columns][None, :]
            add(distance[away], both[away])
        filled = np.flatnonzero(counts)
        return pa.table(
            {
                "site_id": B.key_columns(table, len(filled)),
                "bin": pa.array(filled, pa.int32()),
                "pairs": pa.array(counts[filled].astype(np.int64), pa.int64()),
            }
        )

    return kernel


def pair_histogram(
    vectors: DataFrame,
    dimensions: int,
    metric: str = "euclid",
    bins: int = 50,
    group_rows: int | None = None,
) -> DataFrame:
    """Equal-width histogram of each site's non-zero pair distances."""
    bounds = (
        pair_distance_stats(vectors, dimensions, metric, group_rows)
        .filter(F.col("min_distance").isNotNull())
        .select("site_id", "min_distance", "max_distance")
    )
    cells = _cells(weighted_copies(vectors), vectors, dimensions, group_rows)
    partial = B.run_cells(
        attach_by_site(cells, bounds),
        _histogram_kernel(metric, bins),
        "site_id string, bin int, pairs bigint",
    )
    return partial.groupBy("site_id", "bin").agg(F.sum("pairs").alias("pairs"))


# --- E2, E4: largest distance without all pairs -------------------------------------------


def _hull(points: np.ndarray) -> np.ndarray:
    """Corner points of a planar set (monotone chain)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(ordered) -> list:
        kept: list = []
        for p in ordered:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept

    listed = points.tolist()
    return np.array(chain(listed)[:-1] + chain(listed[::-1])[:-1])


def _hull_batches(batches):
    """Replace the rows of every site in an Arrow batch by its hull corners."""
    for batch in batches:
        frame = batch.to_pandas()
        for site, part in frame.groupby("site_id", sort=False):
            corners = _hull(part[["x", "y"]].to_numpy())
            yield pa.RecordBatch.from_pydict(
                {
                    "site_id": pa.array([site] * len(corners), pa.string()),
                    "x": pa.array(corners[:, 0], pa.float64()),
                    "y": pa.array(corners[:, 1], pa.float64()),
                }
            )


def _max_kernel(metric: str):
    measure = B.euclidean if metric == "euclid" else B.cosine

    def kernel(table: pa.Table) -> pa.Table:
        values = B.matrix(table, "embedding")
        if metric == "cosine":
            values = B.unit_rows(values)
        best = 0.0
        for _, _, distance, mask in B.tiles(table, values, measure):
            if mask is not None:
                distance = np.where(mask, distance, 0.0)
            best = max(best, float(distance.max()))
        return pa.table(
            {"site_id": B.key_columns(table, 1), "diameter": pa.array([best], pa.float64())}
        )

    return kernel


def _cell_max(
    vectors: DataFrame, sized_by: DataFrame, dimensions: int, metric: str, group_rows: int | None
) -> DataFrame:
    rows = vectors.select("site_id", "embedding").distinct()
    rows = rows.withColumn("rep", F.xxhash64("embedding"))
    size = group_rows or B.rows_per_group(dimensions)
    cells = B.to_cells(rows, B.site_groups(sized_by, size), "rep")
    partial = B.run_cells(cells, _max_kernel(metric), "site_id string, diameter double")
    return partial.groupBy("site_id").agg(F.max("diameter").alias("diameter"))


def diameter_2d(points: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Largest planar distance per site: hull corners of each Arrow batch, then hull
    corners of bounded salted groups, then the pairs of what is left, in cells."""
    clean = points.select("site_id", F.col("x").cast("double"), F.col("y").cast("double"))
    schema = "site_id string, x double, y double"
    local = clean.mapInArrow(_hull_batches, schema)
    # spread a site's corners over tasks by value, then shrink each share again
    spread = local.repartition("site_id", F.pmod(F.xxhash64("x", "y"), F.lit(16)))
    corners = spread.mapInArrow(_hull_batches, schema)
    flat = corners.select("site_id", F.array("x", "y").alias("embedding"))
    return _cell_max(flat, corners, 2, "euclid", group_rows)


def diameter_cosine(
    vectors: DataFrame, dimensions: int, group_rows: int | None = None
) -> DataFrame:
    """Largest cosine distance per site.

    Sites of a single cell go there directly; bigger ones are pruned first. The zero
    vector is at distance one from everything and stays outside.
    """
    size = group_rows or B.rows_per_group(dimensions)
    sites = vectors.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("pages"), F.max(V.norm("embedding") == 0).alias("has_zero")
    )
    crowded = sites.filter(F.col("pages") > size).select("site_id")
    directions = vectors.filter(V.norm("embedding") > 0).select("site_id", "embedding")
    rows = directions.join(crowded, "site_id", "left_anti").unionByName(
        _widest_pages(attach_by_site(directions, crowded))
    )
    # sized by the page count, an upper bound that does not repeat the pruning. Cells are as large as a task
    # holds, whatever size a site is pruned from: rows are copied once for every group of their site.
    best = _cell_max(rows, vectors, dimensions, "cosine", max(size, B.rows_per_group(dimensions)))
    floor = F.when(F.col("has_zero") & (F.col("pages") > 1), 1.0).otherwise(0.0)
    return sites.join(best, "site_id", "left").select(
        "site_id", F.greatest(F.coalesce("diameter", F.lit(0.0)), floor).alias("diameter")
    )


def _widest_pages(directions: DataFrame) -> DataFrame:
    """Drop pages that cannot belong to the widest pair, by angles; exact.

    With c the mean, no pair of v opens wider than angle(v, c) + the widest angle to c.
    A sweep from the page farthest from c gives a true lower bound for the widest pair.
    """

    def angle(a: str, b: str) -> Column:
        cosine = V.dot(a, b) / (V.norm(a) * V.norm(b))
        return F.acos(V.clamp(F.coalesce(F.when(V.norm(b) > 0, cosine), F.lit(0.0)), -1.0, 1.0))

    to_middle = attach_by_site(directions, mean_vectors(directions)).select(
        "site_id", "embedding", angle("embedding", "mean").alias("angle")
    )
    far = to_middle.groupBy("site_id").agg(
        F.max("angle").alias("widest"), F.max_by("embedding", "angle").alias("far")
    )
    bound = (
        attach_by_site(to_middle, far)
        .groupBy("site_id")
        .agg(F.max(angle("embedding", "far")).alias("bound"), F.max("widest").alias("widest"))
    )
    # a site whose mean is zero has no usable middle: nothing of it is dropped
    able = F.col("angle") + F.col("widest") >= F.col("bound") - 1e-6
    return attach_by_site(to_middle, bound).filter(able).select("site_id", "embedding")


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """Mean vector per site, accumulated in the JVM before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector("embedding"))
    return vectors.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total"), vector_to_array(mean).alias("mean")
    )


# --- E5: planar near-duplicates by grid ---------------------------------------------------

_FORWARD = ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))
ROWS_PER_SUBCELL = 2048
#: Shares that the pages of one place are dealt to.
PLACE_SHARES = 64


def _grid_pairs(points: DataFrame, threshold: float, rows_per_subcell: int) -> DataFrame:
    """Pairs of places closer than *threshold*, each with its ``pages``.

    Cells have the threshold as side, so partners sit in the same or a touching cell;
    looking only at the five "forward" cells meets each pair once. A crowded cell is cut
    into sub-cells on both sides of the join, so no join key gathers more than about
    ``5 * rows_per_subcell`` by ``rows_per_subcell`` rows.
    """
    cell = ["site_id", "cx", "cy"]
    placed = points.select(
        "site_id",
        "x",
        "y",
        "pages",
        F.floor(F.col("x") / threshold).alias("cx"),
        F.floor(F.col("y") / threshold).alias("cy"),
    ).withColumn("h", F.xxhash64("x", "y", F.col("pages")[0]))
    forward = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in _FORWARD]))

    def moved(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumn("step", forward).select(
            "site_id",
            (F.col("cx") + F.col("step.dx")).alias("cx"),
            (F.col("cy") + F.col("step.dy")).alias("cy"),
            ((F.col("step.dx") == 0) & (F.col("step.dy") == 0)).alias("own"),
            *columns,
        )

    sizes = placed.groupBy(*cell).agg(
        F.ceil(F.count(F.lit(1)) / rows_per_subcell).cast("int").alias("subcells")
    )
    # for each occupied cell: its own sub-cells and the most its visitors' cells have
    visitors = moved(sizes, "subcells").groupBy(*cell).agg(F.max("subcells").alias("slots"))
    layout = sizes.join(visitors, cell)
    left = (
        attach(moved(placed, "x", "y", "h", "pages").withColumnsRenamed({"x": "x1", "y": "y1", "pages": "pages1"}), layout, cell)
        .withColumn("slot", F.pmod("h", "slots").cast("int"))
        .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subcells") - 1)))
        .select(*cell, "slot", "sub", "own", "x1", "y1", "pages1")
    )
    right = (
        attach(placed, layout, cell)
        .withColumn("sub", F.pmod("h", "subcells").cast("int"))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        .select(*cell, "slot", "sub", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("pages").alias("pages2"))
    )
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    once = ~F.col("own") | (F.struct("x1", "y1") < F.struct("x2", "y2"))
    return (
        left.join(right, [*cell, "slot", "sub"])
        .filter(once)
        .select("site_id", "pages1", "pages2", F.sqrt(dx * dx + dy * dy).alias("distance"))
        .filter((F.col("distance") > IDENTICAL) & (F.col("distance") < threshold))
    )


def near_duplicates(
    points: DataFrame, threshold: float = 1.0, rows_per_subcell: int = ROWS_PER_SUBCELL
) -> DataFrame:
    """Pairs of pages with ``1e-9 < distance < threshold`` and both processed paths.

    A place travels with its pages, so no pair is shuffled. The pages of a crowded place travel in
    shares of a place.
    """
    pages = points.select("site_id", "url", F.col("x").cast("double"), F.col("y").cast("double"))
    share = F.pmod(F.xxhash64("url"), F.lit(PLACE_SHARES)).alias("share")
    places = pages.groupBy("site_id", "x", "y", share).agg(F.collect_list(F.struct("url")).alias("pages"))
    close = _grid_pairs(places, threshold, rows_per_subcell)
    for side in ("1", "2"):
        close = close.select("*", F.explode("pages" + side).alias("page")).withColumn("url_" + side, F.col("page.url")).drop("page", "pages" + side)
    return close.select(
        "site_id",
        F.least("url_1", "url_2").alias("url1"),
        F.greatest("url_1", "url_2").alias("url2"),
        "distance",
    ).select(
        "*",
        process_url_path("url1").alias("path1"),
        process_url_path("url2").alias("path2"),
    )


# --- E6: cannibalising pairs --------------------------------------------------------------

_PAIRS = "site_id string, urls1 array<string>, urls2 array<string>, similarity double"


def _order_of(names: pa.ChunkedArray) -> np.ndarray:
    """Rank of every name in the cell."""
    listed = np.array(names.to_pylist(), dtype=object)
    rank = np.empty(len(listed), np.int64)
    rank[np.argsort(listed)] = np.arange(len(listed))
    return rank


def _picked(lists: pa.ChunkedArray, rows: np.ndarray) -> pa.ChunkedArray:
    return lists.take(pa.array(rows.astype(np.int64))).cast(pa.list_(pa.string()))


def _best(keep: list[np.ndarray], limit: int) -> list[np.ndarray]:
    """First *limit* of the columns (similarity, url rank, url rank, row, column)."""
    sim, r1, r2, i, j = keep
    order = np.lexsort((np.maximum(r1, r2), np.minimum(r1, r2), -np.round(sim, RANK_DIGITS)))[:limit]
    return [c[order] for c in (sim, r1, r2, i, j)]


def cell_top_pairs(table: pa.Table, max_distance: float, limit: int) -> tuple[pa.Table, float]:
    """A cell's best *limit* pairs of copy groups, and the largest distance of all its pairs."""
    values = B.unit_rows(B.matrix(table, "embedding"))
    rank = _order_of(table.column("rep"))
    urls = table.column("urls")
    best = [np.empty(0) for _ in range(3)] + [np.empty(0, np.int64) for _ in range(2)]
    twins = best
    widest = 0.0
    if B.is_diagonal(table):
        size = np.array([len(u) for u in urls.to_pylist()])
        own = np.flatnonzero((size > 1) & values.any(axis=1))
        twins = _best([np.ones(len(own)), rank[own], rank[own], own, own], limit)
    for rows, columns, distance, mask in B.tiles(table, values, B.cosine):
        close = distance < max_distance
        if mask is not None:
            close &= mask
        widest = max(widest, float(distance.max(initial=0.0, where=True if mask is None else mask)))
        r, c = np.nonzero(close)
        if not len(r):
            continue
        sim = 1.0 - distance[r, c]
        if len(sim) > limit:
            # everything as close as the limit-th pair, with those that rounding ties to it
            least = np.partition(sim, len(sim) - limit)[len(sim) - limit] - 10.0**-RANK_DIGITS
            near = sim >= least
            r, c, sim = r[near], c[near], sim[near]
        found = [sim, rank[rows[r]], rank[columns[c]], rows[r], columns[c]]
        best = _best([np.concatenate(pair) for pair in zip(best, found)], limit)
    sim, r1, r2, i, j = (np.concatenate(pair) for pair in zip(best, twins))
    first, second = np.where(r1 <= r2, i, j), np.where(r1 <= r2, j, i)
    pairs = pa.table(
        {
            "site_id": B.key_columns(table, len(sim)),
            "urls1": _picked(urls, first),
            "urls2": _picked(urls, second),
            "similarity": pa.array(sim, pa.float64()),
        }
    )
    return pairs, widest


def _top_pairs_kernel(max_distance: float, limit: int):
    def kernel(table: pa.Table) -> pa.Table:
        return cell_top_pairs(table, max_distance, limit)[0]

    return kernel


def _expand_top_pairs(group_pairs: DataFrame, limit: int) -> DataFrame:
    """From pairs of copy groups to the first *limit* page pairs of each site."""
    closeness = F.round("similarity", RANK_DIGITS).desc()
    lead = [closeness, F.asc("first1"), F.asc("first2")]
    slim = group_pairs.withColumns({"first1": F.col("urls1")[0], "first2": F.col("urls2")[0]})
    # pairs inside a group and between groups are ranked apart: only between groups do
    # the first URLs name the best pair
    rank = F.row_number().over(Window.partitionBy("site_id", "same").orderBy(*lead))
    pages = (
        slim.withColumn("same", F.col("first1") == F.col("first2"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= limit)
        .withColumn("a", F.explode("urls1"))
        .withColumn("b", F.explode("urls2"))
        .filter(~F.col("same") | (F.col("a") < F.col("b")))
        .select(
            "site_id",
            F.least("a", "b").alias("url1"),
            F.greatest("a", "b").alias("url2"),
            "similarity",
        )
    )
    best = Window.partitionBy("site_id").orderBy(closeness, "url1", "url2")
    return pages.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def cannibalization(
    vectors: DataFrame,
    dimensions: int,
    max_distance: float = CANNIBAL_DISTANCE,
    limit: int = CANNIBAL_LIMIT,
    group_rows: int | None = None,
) -> DataFrame:
    """The *limit* most similar page pairs per site below a cosine distance, copies
    included. Every pair is compared; each cell keeps its own best *limit* only.

    A group of copies needs no more than its first ``limit + 1`` URLs: any pair with a
    later URL is preceded by *limit* pairs of the same similarity.
    """
    groups = listed_copies(vectors, limit + 1)
    cells = _cells(groups, vectors, dimensions, group_rows)
    return _expand_top_pairs(
        B.run_cells(cells, _top_pairs_kernel(max_distance, limit), _PAIRS), limit
    )


# --- E6 / E7 on sparse vectors: prefix-filtered term join ----------------------------------

POSTINGS_PER_SUBLIST = 512


@F.pandas_udf(ArrayType(DoubleType()))
def _rests(weights: pd.Series) -> pd.Series:
    """Length of every row from each of its entries on."""
    return weights.map(lambda w: np.sqrt(np.cumsum(np.square(w)[::-1])[::-1]))


# keeps the optimizer from copying the call into pushed-down filters, where it cannot run
_rests = _rests.asNondeterministic()


def similar_term_pairs(
    vectors: DataFrame,
    min_similarity: float = 1 - CANNIBAL_DISTANCE,
    limit: int = CANNIBAL_LIMIT,
    postings_per_sublist: int = POSTINGS_PER_SUBLIST,
) -> DataFrame:
    """:func:`cannibalization` for sparse rows of length at most one, without comparing
    all pairs.

    A prefix is the leading (rarest) terms, as many as leave a rest shorter than the
    threshold. Two rows as similar as that share a term of both prefixes, namely the first
    one they have in common. Terms of a single page find no partner and are not posted. A
    long posting list is cut into sub-lists that meet in cells, as in the block join, so
    no key gathers it whole. Where lists hold so many pairs that comparing all pages is less
    work, a site's pages are compared whole, in cells.
    """
    rows = vectors.withColumns({"h1": F.xxhash64("terms"), "h2": F.xxhash64(F.lit(7), "terms")})
    groups = SP.copy_groups(rows, limit + 1)
    names = groups.select("page", "urls")
    twins = groups.filter((F.size("urls") > 1) & (F.col("own") > min_similarity)).select(
        "site_id", F.col("urls").alias("urls1"), F.col("urls").alias("urls2"), F.col("own").alias("similarity")
    )
    # a posting is light: the weights are looked up for candidate pairs only
    needed = min_similarity - 1e-9
    listed = F.transform(
        F.arrays_zip("terms", "rest"),
        lambda e: F.struct(e["terms"]["df"].alias("df"), e["terms"]["tid"].alias("tid"), e["rest"].alias("rest")),
    )
    posted = stored(
        groups.select("site_id", "page", "terms", _rests(F.col("terms.w")).alias("rest"))
        .withColumn("prefix", F.filter(listed, lambda t: t["rest"] >= needed))
        .select("site_id", "page", F.explode("prefix").alias("posted"))
        .select("site_id", "page", "posted.tid", "posted.df", "posted.rest"),
        "posted",
    )
    dense = _dense_sites(posted, groups)
    whole = SP.all_pairs(groups.join(dense, "site_id", "left_semi"), min_similarity, limit)
    candidates = _candidates(posted.join(dense, "site_id", "left_anti"), needed, postings_per_sublist)
    met = SP.measured(candidates, groups).filter(F.col("similarity") > min_similarity).unionByName(whole)
    # the pairs that may be shown are few: only they get their URLs
    closeness = [F.round("similarity", RANK_DIGITS).desc(), F.asc("page1"), F.asc("page2")]
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy(*closeness))).filter(F.col("rank") <= limit)
    for side in ("1", "2"):
        met = met.join(names.withColumnsRenamed({"page": "page" + side, "urls": "urls" + side}), "page" + side)
    return _expand_top_pairs(met.select("site_id", "urls1", "urls2", "similarity").unionByName(twins), limit)


# Sites whose posting lists hold more pairs than this share of all pairs of their pages are compared whole.
DENSE_SHARE = 0.25


def _dense_sites(posted: DataFrame, groups: DataFrame) -> DataFrame:
    lists = posted.groupBy("site_id", "tid").agg(F.count(F.lit(1)).alias("n")).groupBy("site_id").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    pages = groups.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"))
    share = DENSE_SHARE * F.col("pages") * (F.col("pages") - 1) / 2
    return stored(lists.join(pages, "site_id").where(F.col("pairs") > share).select("site_id"), "dense")


def _candidates(posted: DataFrame, needed: float, postings_per_sublist: int) -> DataFrame:
    """Pairs of pages (``page1 < page2``) that meet in a posting list and may be similar enough."""
    placed = (
        posted.withColumn("sublists", F.ceil(F.col("df") / postings_per_sublist).cast("int"))
        .withColumn("grp", F.pmod(F.xxhash64("page"), F.col("sublists")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sublists") - 1)))
        .select("site_id", "tid", F.least("grp", "other").alias("ci"), F.greatest("grp", "other").alias("cj"), "page", "grp", "rest")
    )
    cell = ["site_id", "tid", "ci", "cj"]
    carried = ("page", "grp", "rest")
    left = placed.withColumnsRenamed({c: c + "1" for c in carried})
    right = placed.withColumnsRenamed({c: c + "2" for c in carried})
    return (
        left.join(right, cell)
        .filter(F.col("page1") < F.col("page2"))
        .filter((F.col("ci") == F.col("cj")) | (F.col("grp1") != F.col("grp2")))
        # at the first common term the rests bound the similarity; later ones may fail
        .filter(F.col("rest1") * F.col("rest2") > needed)
        .select("site_id", "page1", "page2")
        .distinct()
    )


# --- E8: pair scope -----------------------------------------------------------------------


def pair_scope(pairs: DataFrame, sources: DataFrame, scope: str = "all") -> DataFrame:
    """Both pages' sitemaps beside each pair; keep ``all``, ``same`` or ``different``."""
    scoped = pairs
    for side in ("1", "2"):
        named = with_source(scoped.withColumnRenamed("url" + side, "url"), sources)
        scoped = named.withColumnsRenamed({"url": "url" + side, "source_sitemap": "source" + side})
    if scope == "same":
        return scoped.filter(F.col("source1") == F.col("source2"))
    if scope == "different":
        return scoped.filter(F.col("source1") != F.col("source2"))
    return scoped


# --- E10: nearest neighbours --------------------------------------------------------------

_NEIGHBOURS = "site_id string, rep string, urls array<string>, distance double"


def _nearest_kernel(limit: int, metric: str = "cosine"):
    measure = B.euclidean if metric == "euclid" else B.cosine

    def kernel(table: pa.Table) -> pa.Table:
        values = B.matrix(table, "embedding")
        if metric == "cosine":
            values = B.unit_rows(values)
        rank = _order_of(table.column("rep"))
        group = table.column("grp").to_numpy()
        diagonal = B.is_diagonal(table)
        ci = table.column("ci")[0].as_py()
        sides = [(np.flatnonzero(group == ci),) * 2]
        if not diagonal:
            other = np.flatnonzero(group != ci)
            sides = [(sides[0][0], other), (other, sides[0][0])]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for queries, targets in sides:
            if not len(targets):
                continue
            height = max(1, min(B.TILE_ROWS, B.TILE_VALUES // len(targets)))
            for start in range(0, len(queries), height):
                rows = queries[start : start + height]
                exact = measure(values[rows], values[targets])
                distance = np.round(exact, RANK_DIGITS)
                if len(targets) > limit:
                    last = np.partition(distance, limit - 1, axis=1)[:, limit - 1]
                    r, c = np.nonzero(distance <= last[:, None])
                else:
                    r, c = np.nonzero(np.ones_like(distance, bool))
                order = np.lexsort((rank[targets[c]], distance[r, c], r))
                r, c = r[order], c[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                r, c = r[place < limit], c[place < limit]
                found.append((rows[r], targets[c], exact[r, c]))
        q, t, d = (np.concatenate(part) for part in zip(*found)) if found else ([], [], [])
        q, t = np.asarray(q, np.int64), np.asarray(t, np.int64)
        return pa.table(
            {
                "site_id": B.key_columns(table, len(q)),
                "rep": table.column("rep").take(pa.array(q)),
                "urls": _picked(table.column("urls"), t),
                "distance": pa.array(d, pa.float64()),
            }
        )

    return kernel


def nearest_pages(
    vectors: DataFrame, dimensions: int, k: int = 15, group_rows: int | None = None, metric: str = "cosine"
) -> DataFrame:
    """The k nearest other pages of every page by cosine distance, or with *metric* "euclid".

    Copies share one search: each distinct vector finds its k + 1 nearest distinct
    vectors (itself among them), which stand for at least its pages' k nearest.
    """
    groups = listed_copies(vectors, k + 1)
    cells = _cells(groups, vectors, dimensions, group_rows)
    local = B.run_cells(cells, _nearest_kernel(k + 1, metric), _NEIGHBOURS)
    order = F.round("distance", RANK_DIGITS)
    by_group = Window.partitionBy("site_id", "rep").orderBy(order, F.col("urls")[0])
    by_page = Window.partitionBy("site_id", "rep").orderBy(order, "neighbour")
    candidates = (
        local.withColumn("rank", F.row_number().over(by_group))
        .filter(F.col("rank") <= k + 1)
        .withColumn("neighbour", F.explode("urls"))
        .withColumn("rank", F.row_number().over(by_page))
        .filter(F.col("rank") <= k + 1)
        .groupBy("site_id", "rep")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "neighbour"))).alias("found"))
    )
    # every page of a copy group takes the group's list and drops itself
    key = ["site_id", "h", "embedding"]
    reps = _hashed(vectors).groupBy(*key).agg(F.min("url").alias("rep"))
    members = attach(_hashed(vectors), reps, key).select("site_id", "url", "rep")
    own = F.filter("found", lambda e: e["neighbour"] != F.col("url"))
    return (
        attach(members, candidates, ["site_id", "rep"])
        .select("site_id", "url", F.posexplode(F.slice(own, 1, k)).alias("place", "e"))
        .select(
            "site_id",
            "url",
            (F.col("place") + 1).alias("rank"),
            F.col("e.neighbour").alias("neighbour"),
            F.col("e.distance").alias("distance"),
        )
    )
