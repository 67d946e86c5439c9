"""Topic maps: principal components and neighbour-preserving layouts per site."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.operators import blocks as B
from sitegauge.operators.lookups import attach_by_site
from sitegauge.operators.pairs import mean_vectors, nearest_pages
from sitegauge.operators.sparse import nearest_by_terms, sparse_pca
from sitegauge.session import materialize, scratch_path, spread

PCA_COMPONENTS = 50
SEED = 42


# --- M1: principal components -------------------------------------------------------------


def _oriented(axes: np.ndarray) -> np.ndarray:
    """Rows with their largest loading made positive."""
    lead = np.abs(axes).argmax(axis=1)
    sign = np.sign(axes[np.arange(len(axes)), lead])
    return axes * np.where(sign == 0, 1.0, sign)[:, None]


def _top_axes(gram: np.ndarray, k: int) -> np.ndarray:
    values, columns = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:k]
    return _oriented(columns[:, order].T)


def _projected(table: pa.Table, coords: np.ndarray) -> pa.Table:
    flat = pa.array(np.ascontiguousarray(coords).ravel(), pa.float64())
    width = coords.shape[1]
    offsets = pa.array(np.arange(len(coords) + 1, dtype=np.int32) * width)
    return pa.table(
        {
            "site_id": table.column("site_id"),
            "url": table.column("url"),
            "coords": pa.ListArray.from_arrays(offsets, flat).cast(pa.list_(pa.float64())),
        }
    )


_COORDS = "site_id string, url string, coords array<double>"


def _gram_rows(table: pa.Table) -> pa.Table:
    """Partial scatter matrix around the site's mean, one output row per dimension."""
    x = B.matrix(table, "embedding") - np.array(table.column("mean")[0].as_py())
    gram = x.T @ x
    return pa.table(
        {
            "site_id": B.key_columns(table, len(gram)),
            "axis": pa.array(range(len(gram)), pa.int32()),
            "gram": pa.array(list(gram), pa.list_(pa.float64())),
        }
    )


def _axes_of_site(k: int):
    def kernel(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("axis").to_numpy())
        axes = _top_axes(B.matrix(table, "gram")[order], k)
        return pa.table(
            {
                "site_id": B.key_columns(table, 1),
                "axes": pa.array([axes.ravel()], pa.list_(pa.float64())),
            }
        )

    return kernel


def _project_share(rows: pa.Table, axes: pa.Table) -> pa.Table:
    if not len(rows) or not len(axes):
        return _projected(rows.slice(0, 0), np.zeros((0, 1)))
    x = B.matrix(rows, "embedding") - np.array(axes.column("mean")[0].as_py())
    loading = np.array(axes.column("axes")[0].as_py()).reshape(-1, x.shape[1])
    return _projected(rows, x @ loading.T)


def pca(
    vectors: DataFrame, dimensions: int, k: int = PCA_COMPONENTS, group_rows: int | None = None
) -> DataFrame:
    """Centred principal components of every site: ``site_id, url, coords``.

    Partial scatter matrices of bounded shares of a site's pages are summed, and only the
    d-by-d sum meets in one task: the same for a site of any size.
    """
    k = min(k, dimensions)
    size = group_rows or B.rows_per_group(dimensions)
    groups = B.site_groups(vectors, size)
    big = attach_by_site(vectors.select("site_id", "url", "embedding"), groups).withColumn(
        "share", F.pmod(F.xxhash64("url"), "groups").cast("int")
    )
    means = mean_vectors(big).select("site_id", "mean")
    partial = (
        attach_by_site(big, means)
        .groupBy("site_id", "share")
        .applyInArrow(_gram_rows, "site_id string, axis int, gram array<double>")
    )
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    scatter = partial.groupBy("site_id", "axis").agg(
        vector_to_array(Summarizer.sum(array_to_vector("gram"))).alias("gram")
    )
    axes = scatter.groupBy("site_id").applyInArrow(
        _axes_of_site(k), "site_id string, axes array<double>"
    )
    per_share = (
        axes.join(means, "site_id")
        .join(groups, "site_id")
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        .drop("groups")
    )
    return (
        big.groupBy("site_id", "share")
        .cogroup(per_share.groupBy("site_id", "share"))
        .applyInArrow(_project_share, _COORDS)
    )


# --- M2: neighbour-preserving layout ------------------------------------------------------


@dataclass(frozen=True)
class LayoutStyle:
    """Curve of the low-dimensional similarity ``1 / (1 + a * d^(2b))``."""

    a: float
    b: float
    # a bound only: a site's layout ends when a round moves its pages by less than ``still`` on average
    rounds: int = 200
    repulsion: float = 5.0
    bucket_rows: int = 128
    still: float = 0.02


# The curve for a minimum distance of 0.1, and Student's t.
STYLES = {"umap": LayoutStyle(1.577, 0.895), "tsne": LayoutStyle(1.0, 1.0)}


def _umap_weights(distance: np.ndarray) -> np.ndarray:
    """Membership strengths whose sum is log2(number of neighbours)."""
    k = distance.shape[1]
    excess = np.maximum(distance - distance.min(axis=1, keepdims=True), 0.0)
    target, low, high = np.log2(max(k, 2)), np.zeros(len(distance)), np.full(len(distance), np.inf)
    sigma = np.ones(len(distance))
    for _ in range(40):
        total = np.exp(-excess / sigma[:, None]).sum(axis=1)
        wide = total > target
        high, low = np.where(wide, sigma, high), np.where(wide, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
        sigma = np.maximum(sigma, 1e-6)
    return np.exp(-excess / sigma[:, None])


def _tsne_weights(distance: np.ndarray, perplexity: float) -> np.ndarray:
    """Conditional probabilities with the given perplexity, scaled to sum to one."""
    excess = distance - distance.min(axis=1, keepdims=True)
    low, high = np.zeros(len(distance)), np.full(len(distance), np.inf)
    beta, target = np.ones(len(distance)), np.log(perplexity)
    for _ in range(40):
        p = np.exp(-excess * beta[:, None])
        mass = p.sum(axis=1)
        entropy = np.log(mass) + beta * (excess * p).sum(axis=1) / mass
        flat = entropy > target
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
        beta = np.minimum(beta, 1e9)
    p = np.exp(-excess * beta[:, None])
    return p / p.sum(axis=1, keepdims=True)


def _calibrated(method: str, perplexity: float):
    @F.pandas_udf("array<double>")
    def weights(distances: pd.Series) -> pd.Series:
        listed = distances.tolist()
        lengths = np.array([len(d) for d in listed])
        result: list = [None] * len(listed)
        # rows of small sites have fewer neighbours; handle equal lengths together
        for k in np.unique(lengths):
            rows = np.flatnonzero(lengths == k)
            d = np.vstack([listed[i] for i in rows])
            w = _umap_weights(d) if method == "umap" else _tsne_weights(d, min(perplexity, k))
            for i, row in zip(rows, w):
                result[i] = row.tolist()
        return pd.Series(result, dtype=object)

    return weights


def neighbours_wanted(method: str, neighbours: int, perplexity: float) -> int:
    return neighbours if method == "umap" else int(3 * perplexity)


def neighbour_graph(nearest: DataFrame, method: str = "umap", perplexity: float = 30.0) -> DataFrame:
    """Symmetric weighted edges ``site_id, url, neighbour, w``, both directions present.

    *nearest* has every page's nearest ones: ``site_id, url, rank, neighbour, distance``.
    """
    found = nearest.groupBy("site_id", "url").agg(
        F.array_sort(F.collect_list(F.struct("rank", "distance", "neighbour"))).alias("found")
    )
    weighted = found.withColumn(
        "w", _calibrated(method, perplexity)(F.transform("found", lambda e: e["distance"]))
    )
    directed = weighted.select(
        "site_id", "url", F.explode(F.arrays_zip("found", "w")).alias("e")
    ).select("site_id", "url", F.col("e.found.neighbour").alias("neighbour"), "e.w")
    both = directed.unionByName(
        directed.select(
            "site_id", F.col("neighbour").alias("url"), F.col("url").alias("neighbour"), "w"
        )
    )
    a, b = F.max("w"), F.when(F.count(F.lit(1)) > 1, F.min("w")).otherwise(0.0)
    union = a + b - a * b if method == "umap" else (a + b) / 2
    return both.groupBy("site_id", "url", "neighbour").agg(union.alias("w"))


# Pages up to which a site's whole layout runs in one task, and of which a bigger site's cells are made.
LOCAL_PAGES = 4096
# Rounds that the cells of a bigger site take between telling each other where their pages are.
TURN_ROUNDS = 8


def _push(p: np.ndarray, style: LayoutStyle) -> np.ndarray:
    """Mean push of the other pages of a random bucket: a sample of the whole site."""
    gap = p[..., :, None, :] - p[..., None, :, :]
    square = (gap**2).sum(axis=-1)
    push = 2 * style.b / ((0.001 + square) * (1 + style.a * square**style.b))
    return np.clip(push[..., None] * gap, -4, 4).sum(axis=-2) / max(1, p.shape[-2] - 1)


def _pull(gap: np.ndarray, w: np.ndarray, style: LayoutStyle) -> np.ndarray:
    square = (gap**2).sum(axis=1)
    apart = np.where(square > 0, square, 1.0)
    pull = -2 * style.a * style.b * apart ** (style.b - 1) / (1 + style.a * apart**style.b)
    return w[:, None] * np.clip(np.where(square > 0, pull, 0.0)[:, None] * gap, -4, 4)


def _moved(p: np.ndarray, around: np.ndarray, one: np.ndarray, other: np.ndarray, w: np.ndarray, degree: np.ndarray, style: LayoutStyle, rng) -> np.ndarray:
    """How far one round moves the pages *p*: edges go from *one* of them to an *other* of the pages *around*."""
    n, width = p.shape
    force = _pull(p[one] - around[other], w, style)
    moved = np.stack([np.bincount(one, weights=force[:, i], minlength=n) for i in range(width)], axis=1) / degree
    order = rng.permutation(n)
    buckets = -(-n // style.bucket_rows)
    share, more = divmod(n, buckets)
    # buckets of two sizes, one apart
    for rows in (order[: more * (share + 1)].reshape(more, share + 1), order[more * (share + 1) :].reshape(buckets - more, share)):
        if rows.size:
            moved[rows] += style.repulsion * _push(p[rows], style)
    return moved


def _degrees(one: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(np.bincount(one, weights=w, minlength=n), 1e-9)[:, None]


def settle(p: np.ndarray, one: np.ndarray, other: np.ndarray, w: np.ndarray, style: LayoutStyle, rounds: int) -> tuple[np.ndarray, int]:
    """Positions of one site's pages after they hardly move, and the rounds that took."""
    degree = _degrees(one, w, len(p))
    rng = np.random.default_rng(SEED)
    for done in range(rounds):
        step = (1 - done / rounds) * _moved(p, p, one, other, w, degree, style, rng)
        p = p + step
        if np.abs(step).sum(axis=1).mean() < style.still:
            break
    return p, done + 1


def _settle_site(style: LayoutStyle, rounds: int):
    def kernel(pages: pa.Table, edges: pa.Table) -> pa.Table:
        urls = pages.column("url").to_pylist()
        order = sorted(range(len(urls)), key=urls.__getitem__)
        pages = pages.take(pa.array(order, pa.int64()))
        place = {urls[i]: k for k, i in enumerate(order)}
        one, other = (np.array([place[u] for u in edges.column(c).to_pylist()], np.int64) for c in ("url", "neighbour"))
        found, done = settle(B.matrix(pages, "pos"), one, other, edges.column("w").to_numpy(), style, rounds) if urls else (np.zeros((0, 1)), 0)
        return _projected(pages, found).append_column("rounds", pa.array([done] * len(pages), pa.int32()))

    return kernel


_PLACED = "site_id string, cell int, src int, pos array<double>, pages long, step double"


def _own_places(table: pa.Table) -> pa.Table:
    """One row of a cell's positions, in the order of its places."""
    p = B.matrix(table, "pos")[np.argsort(table.column("place").to_numpy())]
    return _placed(table.column("site_id")[0].as_py(), [(table.column("cell")[0].as_py(),) * 2 + (p, len(p), 0.0)])


def _placed(site: str, rows: list[tuple[int, int, np.ndarray, int, float]]) -> pa.Table:
    cell, src, pos, pages, step = zip(*rows)
    return pa.table(
        {
            "site_id": pa.array([site] * len(rows), pa.string()),
            "cell": pa.array(cell, pa.int32()),
            "src": pa.array(src, pa.int32()),
            "pos": pa.array([p.ravel() for p in pos], pa.list_(pa.float64())),
            "pages": pa.array(pages, pa.int64()),
            "step": pa.array(step, pa.float64()),
        }
    )


def _packed_edges(table: pa.Table) -> pa.Table:
    """A cell's edges as one row: ``one`` and ``other`` are places, an ``other`` of another cell is -1 - k for the k-th by (cell, place)."""
    cell = table.column("cell")[0].as_py()
    there, place = (table.column(c).to_numpy().astype(np.int64) for c in ("there", "other"))
    inside, far = there == cell, there << 32 | place
    known = np.unique(far[~inside])
    other = np.where(inside, place, -1 - np.searchsorted(known, far))
    return pa.table(
        {
            "site_id": B.key_columns(table, 1),
            "cell": pa.array([cell], pa.int32()),
            "one": pa.array([table.column("place").to_numpy()], pa.list_(pa.int32())),
            "other": pa.array([other.astype(np.int32)], pa.list_(pa.int32())),
            "w": pa.array([table.column("w").to_numpy()], pa.list_(pa.float64())),
        }
    )


def _turn(style: LayoutStyle, components: int, rounds: int, done: int, steps: int):
    """*steps* rounds of one cell from round *done* on, pages of other cells standing still; then its positions for itself and for the cells that want them."""

    def kernel(cell: pa.Table, told: pa.Table) -> pa.Table:
        if not len(cell) or not len(told):
            return _placed("", [(0, 0, np.zeros((0, components)), 0, 0.0)]).slice(0, 0)
        site, own = cell.column("site_id")[0].as_py(), cell.column("cell")[0].as_py()
        listed = lambda c: np.asarray(cell.column(c)[0].values) if cell.column(c)[0].is_valid else np.zeros(0, np.int64)
        src = told.column("src").to_numpy()
        parts = [np.asarray(told.column("pos")[int(k)].values).reshape(-1, components) for k in np.argsort(src)]
        at = int((src < own).sum())
        p, far = parts.pop(at), np.concatenate([np.zeros((0, components)), *parts])
        one, other, w = listed("one"), listed("other").astype(np.int64), listed("w").astype(float)
        other = np.where(other < 0, len(p) - 1 - other, other)
        degree, rng, step = _degrees(one, w, len(p)), np.random.default_rng([SEED, done, own]), np.zeros_like(p)
        for k in range(done, done + steps):
            step = (1 - k / rounds) * _moved(p, np.concatenate([p, far]), one, other, w, degree, style, rng)
            p = p + step
        to, place = listed("to"), listed("place")
        starts = np.flatnonzero(np.diff(to, prepend=-1))
        sent = [(int(to[a]), own, p[rows], 0, 0.0) for a, rows in zip(starts, np.split(place, starts[1:]))]
        return _placed(site, [(own, own, p, len(p), float(np.abs(step).sum())), *sent])

    return kernel


def _settled_apart(positions: DataFrame, edges: DataFrame, components: int, style: LayoutStyle, rounds: int, cell_pages: int) -> list[DataFrame]:
    """Layouts of sites too big for a task, in cells of about *cell_pages* pages dealt by hash.

    A turn is a few rounds inside every cell, while the pages of other cells stand still; then each cell tells
    the others where those of its pages are that they have edges to. So edges are shuffled once, and a
    turn shuffles positions only. A cell's pages are a random share of its site's, so they push each other for the whole
    site. Positions are checkpointed every turn, which keeps the plan short and survives lost
    executors. A site whose pages hardly move is written and leaves the job; edges are cut to the sites left once half of the pages are gone.
    """
    spark, keys, settled = positions.sparkSession, ["site_id", "cell"], []
    cells = F.ceil(F.col("n") / cell_pages)
    dealt = positions.withColumn("cell", F.pmod(F.xxhash64("url", F.lit(SEED)), cells).cast("int"))
    order = Window.partitionBy(*keys).orderBy("url")
    pages = materialize(dealt.select(*keys, "url", "pos", (F.row_number().over(order) - 1).alias("place")))
    if pages.isEmpty():
        return []
    there = pages.select("site_id", F.col("url").alias("neighbour"), F.col("cell").alias("there"), F.col("place").alias("other"))
    joined = edges.join(pages.drop("pos"), ["site_id", "url"]).join(there, ["site_id", "neighbour"])
    joined = materialize(joined.select(*keys, "place", "there", "other", "w"))
    packed = joined.groupBy(*keys).applyInArrow(_packed_edges, "site_id string, cell int, one array<int>, other array<int>, w array<double>")
    wanted = joined.where("there != cell").select("site_id", F.col("there").alias("cell"), F.col("cell").alias("to"), F.col("other").alias("place")).distinct()
    wanted = wanted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("to", "place"))).alias("wanted"))
    wanted = wanted.select(*keys, F.col("wanted.to").alias("to"), F.col("wanted.place").alias("place"))
    placed = pages.groupBy(*keys).applyInArrow(_own_places, _PLACED)
    known = spread(pages.select(*keys).distinct().join(packed, keys, "left").join(wanted, keys, "left"), *keys)
    known = materialize(known)
    done, left = 0, pages.count()
    held = left
    # the first turn takes no round: it only tells the cells where pages are
    steps = 0
    while left:
        placed = materialize(known.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(_turn(style, components, rounds, done, steps), _PLACED))
        own, done = placed.where("src = cell"), done + steps
        steps, before = min(TURN_ROUNDS, rounds - done), steps
        if not before:
            continue
        movement = materialize(own.groupBy("site_id").agg((F.sum("step") / F.sum("pages")).alias("movement"), F.sum("pages").alias("pages")))
        rests = (F.col("movement") < style.still) | F.lit(done >= rounds)
        still = movement.where(rests).select("site_id")
        if still.isEmpty():
            continue
        path = scratch_path(spark, "settled")
        coords = F.transform(F.sequence(F.lit(0), F.col("pages").cast("int") - 1), lambda k: F.slice("pos", k * components + 1, F.lit(components)))
        at_rest = own.join(still, "site_id", "left_semi").select(*keys, F.posexplode(coords).alias("place", "coords"))
        at_rest = pages.select(*keys, "place", "url").join(at_rest, [*keys, "place"])
        at_rest.select("site_id", "url", "coords", F.lit(done).alias("rounds")).write.parquet(path)
        settled.append(spark.read.parquet(path))
        placed = placed.join(still, "site_id", "left_anti")
        left = movement.where(~rests).agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("left")).first()["left"]
        if left and left * 2 <= held:
            known, held = materialize(spread(known.join(still, "site_id", "left_anti"), *keys)), left
    return settled


def layout(
    start: DataFrame,
    graph: DataFrame,
    components: int = 2,
    method: str = "umap",
    rounds: int | None = None,
    local_pages: int | None = None,
) -> DataFrame:
    """A layout of every site that keeps neighbours together: ``site_id, url, coords, rounds``.

    Starts from *start* (``site_id, url, coords``). Each round pulls along the edges of *graph* and pushes
    away from a fresh random bucket of the site's pages, with steps that shrink. Each site ends by its own
    movement, or after the bound of rounds; ``rounds`` says how many it took. A site of at most *local_pages*
    pages runs in one task; a bigger one in cells of about so many, a few rounds at a time, so it may be of any size. A
    single page gets no row.
    """
    if method not in STYLES:
        raise ValueError("method must be 'umap' or 'tsne'")
    style = STYLES[method]
    rounds = rounds or style.rounds
    local_pages = LOCAL_PAGES if local_pages is None else local_pages
    spread = start.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("coords", F.abs))).alias("widest")
    )
    scale = F.when(F.col("widest") > 0, 10 / F.col("widest")).otherwise(1.0)
    # a reproducible jitter parts copies, which would otherwise stay on one spot
    positions = materialize(
        attach_by_site(start, spread).filter(F.col("n") > 1).select(
            "site_id",
            "url",
            "n",
            F.transform(
                "coords",
                lambda c, i: c * scale
                + (F.pmod(F.xxhash64("url", i, F.lit(SEED)), F.lit(2001)) - 1000) * 1e-6,
            ).alias("pos"),
        )
    )
    edges = materialize(graph)
    small = positions.filter(F.col("n") <= local_pages)
    sites = small.select("site_id").distinct()
    inner = attach_by_site(edges, sites).groupBy("site_id")
    whole = small.select("site_id", "url", "pos").groupBy("site_id").cogroup(inner)
    parts = [whole.applyInArrow(_settle_site(style, rounds), _COORDS + ", rounds int")]
    parts += _settled_apart(positions.filter(F.col("n") > local_pages), edges, components, style, rounds, local_pages or LOCAL_PAGES)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def neighbour_map(
    vectors: DataFrame,
    dimensions: int,
    components: int = 2,
    method: str = "umap",
    neighbours: int = 15,
    perplexity: float = 30.0,
    rounds: int | None = None,
    lone_pages: bool = False,
    group_rows: int | None = None,
    local_pages: int | None = None,
) -> DataFrame:
    """:func:`layout` of dense vectors from their principal components: ``site_id, url, coords``.

    Sites of one page give no row, or the origin with *lone_pages*.
    """
    nearest = nearest_pages(vectors, dimensions, neighbours_wanted(method, neighbours, perplexity), group_rows)
    start = pca(vectors, dimensions, components, group_rows)
    found = layout(start, neighbour_graph(nearest, method, perplexity), components, method, rounds, local_pages)
    return _with_lone_pages(found, vectors, components, lone_pages)


def term_map(
    vectors: DataFrame,
    components: int = 2,
    method: str = "tsne",
    neighbours: int = 15,
    perplexity: float = 30.0,
    rounds: int | None = None,
    lone_pages: bool = False,
    local_pages: int | None = None,
) -> DataFrame:
    """:func:`layout` of sparse term rows (``site_id, url, terms``): ``site_id, url, coords``.

    Neighbours are the exact nearest pages by terms; the start is the rows' principal components. A
    page without terms, or with none that another page has, is pushed only.
    """
    nearest = nearest_by_terms(vectors, neighbours_wanted(method, neighbours, perplexity))
    start = sparse_pca(vectors, components)
    found = layout(start, neighbour_graph(nearest, method, perplexity), components, method, rounds, local_pages)
    return _with_lone_pages(found, vectors, components, lone_pages)


def _with_lone_pages(found: DataFrame, vectors: DataFrame, components: int, lone_pages: bool) -> DataFrame:
    laid_out = found.select("site_id", "url", "coords")
    if not lone_pages:
        return laid_out
    lone = vectors.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).filter("n = 1")
    origin = F.array_repeat(F.lit(0.0), components)
    return laid_out.unionByName(lone.select("site_id", "url", origin.alias("coords")))


def kept_neighbours(nearest: DataFrame, coords: DataFrame, components: int = 2, k: int = 15) -> DataFrame:
    """Per site, ``pages`` and ``kept``: the mean share of a page's k nearest pages that are among its k nearest in the layout."""
    spots = coords.select("site_id", "url", F.col("coords").alias("embedding"))
    close = nearest_pages(spots, components, k, metric="euclid").select("site_id", "url", "neighbour", F.lit(1).alias("met"))
    wanted = nearest.filter(F.col("rank") <= k).select("site_id", "url", "neighbour")
    shares = wanted.join(close, ["site_id", "url", "neighbour"], "left").groupBy("site_id", "url").agg((F.count("met") / F.count(F.lit(1))).alias("share"))
    return shares.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), F.avg("share").alias("kept"))


# --- M3 -----------------------------------------------------------------------------------


def coordinates(layout: DataFrame, components: int = 2) -> DataFrame:
    """Layout as columns: id, url, x, y and, with three components, z."""
    axes = [F.col("coords")[i].alias(name) for i, name in zip(range(components), "xyz")]
    return layout.select("site_id", F.sha2("url", 256).alias("id"), "url", *axes)
