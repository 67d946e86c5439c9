"""Block self-join: every unordered pair of a site meets once, in a bounded task.

A site of n rows is cut into ``G = ceil(n / rows_per_group)`` groups by a hash of the row
id; each row is copied to the G cells ``(min(g, j), max(g, j))``. Rows of different groups
meet in exactly one cell, rows of one group only in ``(g, g)``. A cell holds at most about
two groups, its kernel works in tiles and hands back a reduction, never the pair matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.operators.lookups import attach_by_site

TILE_ROWS = 1024
# Distances of one tile: 16 MiB of doubles, however many rows a cell has.
TILE_VALUES = 1 << 21
# Values of one group's matrix: 64 MiB of doubles.
GROUP_VALUES = 1 << 23

Tile = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def rows_per_group(dimensions: int) -> int:
    return max(256, min(16384, GROUP_VALUES // max(1, dimensions)))


def site_groups(rows: DataFrame, group_rows: int) -> DataFrame:
    """Number of row groups per site."""
    return rows.groupBy("site_id").agg(
        F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("groups")
    )


def to_cells(rows: DataFrame, groups: DataFrame, row_id: str) -> DataFrame:
    """Copy each row to the cells of its group."""
    return copy_to_cells(attach_by_site(rows, groups), row_id)


def copy_to_cells(rows: DataFrame, row_id: str) -> DataFrame:
    """:func:`to_cells` for rows that already carry their site's number of ``groups``."""
    group = F.pmod(F.xxhash64(row_id), F.col("groups")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    return (
        rows.withColumn("grp", group)
        .withColumn("other", other)
        .withColumn("ci", F.least("grp", "other"))
        .withColumn("cj", F.greatest("grp", "other"))
        .drop("groups", "other")
    )


def run_cells(
    cells: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema: str
) -> DataFrame:
    return cells.groupBy("site_id", "ci", "cj").applyInArrow(kernel, schema)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional array."""
    values = table.column(column).combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1)


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        total += np.subtract.outer(a[:, axis], b[:, axis]) ** 2
    return np.sqrt(total)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of rows that are already of length one (or zero)."""
    return np.clip(1.0 - a @ b.T, 0.0, 2.0)


def unit_rows(a: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, length, out=np.zeros_like(a), where=length > 0)


def tiles(table: pa.Table, values: np.ndarray, measure: Measure) -> Iterator[Tile]:
    """Yield (row numbers, column numbers, distances, mask of pairs to use)."""
    group = table.column("grp").to_numpy()
    ci, cj = table.column("ci")[0].as_py(), table.column("cj")[0].as_py()
    left = np.flatnonzero(group == ci)
    right = left if ci == cj else np.flatnonzero(group == cj)
    width = max(1, TILE_VALUES // TILE_ROWS)
    for start in range(0, len(left), TILE_ROWS):
        rows = left[start : start + TILE_ROWS]
        for first in range(start if ci == cj else 0, len(right), width):
            columns = right[first : first + width]
            distance = measure(values[rows], values[columns])
            mask = None
            if ci == cj:
                mask = start + np.arange(len(rows))[:, None] < first + np.arange(len(columns))[None, :]
            yield rows, columns, distance, mask


def is_diagonal(table: pa.Table) -> bool:
    return table.column("ci")[0].as_py() == table.column("cj")[0].as_py()


def key_columns(table: pa.Table, count: int) -> pa.Array:
    """The site of a cell, repeated for its output rows."""
    return pa.array([table.column("site_id")[0].as_py()] * count, pa.string())
