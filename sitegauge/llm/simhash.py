"""SimHash near-duplicates: fingerprints linked by vantage-point trees.

Two fingerprints of 64 bits that differ in at most ``radius`` bits differ in at most
``radius // 2`` bits in one of their halves. So each half has a vantage-point tree of its own, over
Hamming distance in that half: a node splits by the distance to its vantage point, and the triangle
bound says that a pair within the half's radius shares a side unless it straddles the split, so
only fingerprints on the boundary go to both sides. Leaves are the shards of a shuffle; inside
a shard the same splitting goes on down to blocks small enough to compare directly, by all 64 bits.
A crowded leaf that no vantage point divides is dealt into groups, and every two groups share
a shard, so no task gets more than a shard's rows of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from sitegauge.llm.common import free
from sitegauge.llm.components import components
from sitegauge.session import materialize

SEED = 42
WIDTH = 3
RADIUS = 3
#: Distinct fingerprints that shape the trees, and the largest share of all. They set the balance, never the result.
SAMPLE_ROWS = 1 << 17
SAMPLE_SHARE = 0.25
#: Fingerprints a shard should hold, and a block that is compared directly.
SHARD_ROWS = 1 << 14
BLOCK_ROWS = 512
#: A split must leave each side less than this share of the rows.
WORST_SPLIT = 0.85
#: Links of a shard that are held before they are reduced to one for each linked fingerprint.
HELD_LINKS = 1 << 20


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Signed 64-bit SimHash of the text's word shingles, A-Z lower-cased; zero without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    if len(tokens) < width:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark (of doc_id and text together) and fp of every row; a null text counts as empty, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(marks, pa.int64())], ["doc_id", "mark", "fp"])

    schema = StructType([docs.schema["doc_id"]]).add("mark", StringType()).add("fp", LongType())
    return docs.select("doc_id", _mark(docs).alias("mark"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _mark(docs: DataFrame) -> Column:
    """128 bits of a row's doc_id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("none")), F.coalesce(docs["text"].cast("string"), F.lit(""))))


def _half(fps: np.ndarray, side: int) -> np.ndarray:
    return (fps.view(np.uint64) >> np.uint64(32 * side)).astype(np.uint32)


def _split(half: np.ndarray, rng: np.random.Generator, radius: int) -> tuple[int, int, np.ndarray] | None:
    """Vantage point, split and distances of the most even of a few splits; None if none is even."""
    best = None
    for point in half[rng.integers(0, len(half), 6)]:
        away = np.bitwise_count(half ^ point)
        middle = int(np.median(away))
        most = max((away <= middle + (radius - 1) // 2).mean(), (away >= middle - radius // 2).mean())
        if best is None or most < best[0]:
            best = (most, int(point), middle, away)
    return best[1:] if best[0] < WORST_SPLIT else None


def _sides(away: np.ndarray, middle: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' rows. Any two distances at most ``radius`` apart are together on one of them."""
    return np.flatnonzero(away <= middle + (radius - 1) // 2), np.flatnonzero(away >= middle - radius // 2)


def grow_tree(sample: np.ndarray, total: int, side: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (point, split, left, right); a child below zero is the shard of that number.

    A split below zero marks a crowded leaf of that many groups, its shards numbered from left.
    """
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0
    rng = np.random.default_rng(SEED)

    def grow(half: np.ndarray) -> int:
        nonlocal shards
        crowded = len(half) >= 32 and len(half) * total > SHARD_ROWS * len(sample)
        cut = _split(half, rng, radius) if crowded else None
        if not crowded:
            shards += 1
            return -shards
        at = len(nodes)
        if cut is None:
            groups = -(-2 * len(half) * total // (SHARD_ROWS * len(sample)))
            nodes.append((0, -groups, shards + 1, 0))
            shards += groups * (groups - 1) // 2
            return at
        nodes.append((0, 0, 0, 0))
        left, right = _sides(cut[2], cut[1], radius)
        nodes[at] = (cut[0], cut[1], grow(half[left]), grow(half[right]))
        return at

    if grow(_half(sample, side)) < 0:
        return []
    return nodes


def _route(nodes: list, fps: np.ndarray, side: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows) for every shard that some rows belong to."""
    if not nodes:
        yield 0, np.arange(len(fps))
        return
    half = _half(fps, side)
    open_ = [(0, np.arange(len(fps)))]
    while open_:
        at, rows = open_.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -at, rows
            continue
        point, middle, left, right = nodes[at]
        if middle < 0:
            group = (fps[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(-middle)
            for shard, (one, other) in enumerate(combinations(range(-middle), 2), left):
                part = rows[(group == one) | (group == other)]
                if len(part):
                    yield shard, part
            continue
        for child, part in zip((left, right), _sides(np.bitwise_count(half[rows] ^ np.uint32(point)), middle, radius)):
            open_.append((child, rows[part]))


def _stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Every linked fingerprint of a block and the first of its component within the block."""
    bits = fps.view(np.uint64)  # counting bits takes signed numbers for their size
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    linked = np.flatnonzero(near.sum(axis=1) > 1)
    root = np.full(len(fps), -1)
    for row in linked:
        if root[row] >= 0:
            continue
        seen, front = near[row].copy(), near[row]
        while True:
            reach = near[front].any(axis=0) & ~seen
            if not reach.any():
                break
            seen |= reach
            front = reach
        root[seen] = row
    rows = linked[root[linked] != linked]
    return fps[rows], fps[root[rows]]


def shard_links(fps: np.ndarray, side: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect, within this shard, all fingerprints at most ``radius`` bits apart."""
    rng = np.random.default_rng(SEED)
    open_ = [np.unique(fps)]
    while open_:
        part = open_.pop()
        if len(part) <= BLOCK_ROWS:
            yield _stars(part, radius)
            continue
        half = _half(part, side)
        cut = _split(half, rng, radius // 2)
        if cut:
            open_ += [part[rows] for rows in _sides(cut[2], cut[1], radius // 2)]
            continue
        blocks = np.array_split(part, -(-len(part) // (BLOCK_ROWS // 2)))
        for i, one in enumerate(blocks):  # a dense cluster: every two blocks are compared
            for other in blocks[i + 1 :]:
                yield _stars(np.concatenate([one, other]), radius)


def reduced(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every linked fingerprint to the first of its component, in place of the links given."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, other = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while (apart := root[one] != root[other]).any():
        one, other = one[apart], other[apart]
        a, b = root[one], root[other]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    rows = np.flatnonzero(root != np.arange(len(names)))
    return names[rows], names[root[rows]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) links among distinct fingerprints ``fp``.

    They connect whatever is connected by pairs at most ``radius`` bits apart, but are stars of
    each block and not all pairs, so a dense group gives each shard no more links than fingerprints.
    """
    spark = fps.sparkSession
    total = fps.count()
    share = min(SAMPLE_SHARE, SAMPLE_ROWS / max(total, 1))
    picked = fps.where(F.pmod(F.xxhash64("fp", F.lit("shape")), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = np.array([r["fp"] for r in picked.limit(2 * SAMPLE_ROWS).collect()], dtype=np.int64)
    trees = [grow_tree(sample, total, side, radius // 2) for side in (0, 1)]
    shared = spark.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            for side, nodes in enumerate(shared.value):
                for shard, rows in _route(nodes, values, side, radius // 2):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), side, np.int32)), pa.array(np.full(len(rows), shard, np.int32)), pa.array(values[rows])],
                        ["side", "shard", "fp"],
                    )

    def join(key: tuple, part: pa.Table) -> pa.Table:
        held, count = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for found in shard_links(part.column("fp").to_numpy(), key[0].as_py(), radius):
            held.append(found)
            count += len(found[0])
            if count > HELD_LINKS:
                held = [reduced(*map(np.concatenate, zip(*held)))]
                count = 0
        u, v = reduced(*map(np.concatenate, zip(*held)))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    routed = fps.mapInArrow(route, "side int, shard int, fp long")
    return routed.groupBy("side", "shard").applyInArrow(join, "u long, v long")


def _classes(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """doc_id, mark, fp, root (least fingerprint of the component) and component_id of every row."""
    marked = materialize(with_fingerprints(docs, width))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (least doc_id that links reach, itself included) of every row.

    Texts that are null, empty or white space have fingerprint zero and are linked like any other.
    Repeated rows stay repeated. A null doc_id takes part through its text but names no component:
    one of only null ids has a null component_id. An empty table gives an empty result. Further
    columns of ``docs`` are ignored.
    """
    return _classes(docs, width, radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the row with the least doc_id.

    A component of rows without any doc_id keeps one of them. Where one doc_id has several texts in a
    component, one of them stays; in different components, each is judged with its own. Repeated rows
    with that doc_id and text count once. Null and empty texts are copies of each other. Columns stay as
    they are, whatever their names; an empty table gives an empty result.
    """
    found = _classes(docs, width, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")).alias("first")
    name = free(docs.columns, "mark")
    kept = found.groupBy("root").agg(first).select(F.col("first.mark").alias(name))
    return docs.withColumn(name, _mark(docs)).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
