"""Shared pieces: tables, word arrays, bounded broadcasts, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes up to which a counted side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Characters that one vectorised step works on.
SLICE_CHARS = 1 << 19
#: White space between words, as a Java pattern.
GAP = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas use it again and again."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def free(columns: list[str], name: str) -> str:
    """``name``, or a longer one that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def counted_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join side: broadcast if its counted rows allow it, else left to a shuffled join."""
    return F.broadcast(df) if counted_small(df, rows) else df


def crc_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def pieces(texts: list[str | None], size: int = SLICE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Groups of (row, piece) of bounded length; a longer text is cut at white space where it has any."""
    group: list[tuple[int, str]] = []
    held = 0
    for row, text in enumerate(texts):
        start, text = 0, text or ""
        while True:
            end = start + size
            if end < len(text):
                cut = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))
                end = cut if cut > start else end
            piece = text[start:end]
            if held and held + len(piece) > size:
                yield group
                group, held = [], 0
            group.append((row, piece))
            held += len(piece) + 1
            start = end
            if start >= len(text):
                break
    if group:
        yield group


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
