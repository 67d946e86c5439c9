"""Exact join of documents by the Jaccard similarity of their word shingles, over parity sketches.

A document's sketch has one bit for each hash place; every shingle flips its own. Bits that differ
between two sketches are at most the shingles that only one of the documents has, so few differing bits
are needed where the similarity is high. Documents are in bands by the size of their sets; a band says
into how many blocks the sketch is cut. Of blocks so many must be equal in two similar
documents that, all documents' blocks put into one order, the first few of either must share one
(``blocks``): those are the keys of the join. Blocks of shingles that many documents have come last in the
order, so a passage shared by many documents is no key unless a document has nothing else.

Documents that share a key are compared by their sketches folded to a byte a block, whose differing bits
still bound the difference from below, and what passes is verified by the whole sets of shingles.
A key's documents are first compared with the least of them; only if they are not all of one component
then, those of different components are compared with each other. So copies, however many, cost a link each, and
no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegauge.llm.common import small_side
from sitegauge.llm.components import components
from sitegauge.session import let_go, materialize, scratch_path

WIDTH = 5
#: Least similarity, in hundredths: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Blocks of a band: a share of its least set size, and a fixed number.
BLOCK_SHARE = 0.7
BLOCKS_MORE = 32
#: Documents of which frequent shingles are learnt, and how many; they set the order of blocks, never the result.
SAMPLE_DOCS = 8_192
FREQUENT_ROWS = 1 << 16
#: Documents of a key from which it is compared in blocks of so many, each a task's group.
CROWD = 64
CROWD_BLOCK = 1_024
#: Shingles of a document's partners that one salted share of them may hold.
SHARE_SHINGLES = 1 << 20
#: Rows of two numbers that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Shingles whose blocks are formed together.
BLOCKED_AT_ONCE = 1 << 17
#: Words hashed that a worker keeps.
CACHE_ROWS = 500_000

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """The numbers with their bits mixed, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_ODD[4])
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_ODD[5])
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int, seed: int) -> None:
        self.width, self.seed = width, seed
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "replace").lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        known, seed = self.known, self.seed
        if len(known) > CACHE_ROWS:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, seed)
        words = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        width = min(self.width, len(words))
        sums = np.full(len(words) - width + 1, width + seed, np.uint64)
        for k in range(width):
            sums = mixed(sums + words[k : len(words) - width + 1 + k] * np.uint64(_ODD[0]))
        return np.unique(sums)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same for equal sets; as signed numbers."""
    raw = shingles.tobytes()
    return tuple(np.array([xxhash.xxh64_intdigest(raw, seed) for seed in (1, 2)], np.uint64).view(np.int64).tolist())


def bands_of(size: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(least size of the band, most shingles of difference) for each band in which a set of this size has partners.

    A band holds the sizes from a power of two to the next, a pair belongs to the band of the smaller
    set. Sets a and b of similarity t differ in at most (1 - t) / (1 + t) * (a + b) shingles, and the
    smaller has at least t times the larger's. Sets that may differ in nothing have no partner but copies.
    """
    if not size:
        return []
    apart = lambda other: (100 - percent) * (size + other) // (100 + percent)
    own = 1 << (size.bit_length() - 1)
    found = [(own, apart(100 * size // percent))]
    least = -(-percent * size // 100)
    while least < found[-1][0]:
        found.append((found[-1][0] // 2, apart(found[-1][0] - 1)))
    return [f for f in found if f[1]]


def blocks(
    sets: list[np.ndarray], bands: list[int], aparts: list[int], frequent: tuple[np.ndarray, np.ndarray]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each set, in its band: join keys, and the folded sketch, one byte a block.

    Two sets that differ in d shingles have at least (blocks - d) equal blocks. In any order that goes
    by a block's own content, the first of those is among the first d + 1 blocks of both sets. The
    order here: blocks that hold a rare shingle first, those of several shingles before single ones, empty blocks last.
    All sets are worked on at once, their blocks one after the other.
    """
    counts = np.array([int(BLOCK_SHARE * b) + BLOCKS_MORE for b in bands])
    first = np.concatenate([[0], np.cumsum(counts)])
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingles = np.concatenate(sets)
    place = ((shingles * np.uint64(_ODD[1])) >> np.uint64(32)) % counts[own].astype(np.uint64)
    place = place.astype(np.int64) + first[own]
    order = np.argsort(place, kind="stable")
    place, shingles = place[order], shingles[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    names = place[starts]
    content = np.zeros(first[-1], np.uint64)
    content[names] = np.bitwise_xor.reduceat(mixed(shingles * np.uint64(_ODD[2])), starts)
    folded = np.zeros(first[-1], np.uint8)
    folded[names] = np.bitwise_xor.reduceat(np.uint8(1) << (shingles >> np.uint64(61)).astype(np.uint8), starts)
    common = np.full(first[-1], np.iinfo(np.int64).max)
    seen = np.zeros(len(shingles), np.int64)
    if len(frequent[0]):
        at = np.searchsorted(frequent[0], shingles)
        at[at == len(frequent[0])] = 0
        seen = np.where(frequent[0][at] == shingles, frequent[1][at], 0)
    common[names] = np.minimum.reduceat(seen, starts)
    sizes = np.zeros(first[-1], np.int64)
    sizes[names] = -np.diff(np.append(starts, len(place)))
    of = np.repeat(np.arange(len(sets)), counts)
    number = np.arange(first[-1]) - first[of]
    key = mixed(content + number.astype(np.uint64) * np.uint64(_ODD[3]) + np.array(bands, np.uint64)[of])
    ranked = np.lexsort((key, sizes, common, of))
    key = key[ranked]
    found = []
    for k, apart in enumerate(aparts):
        sketch = np.zeros(-(-counts[k] // 8) * 8, np.uint8)
        sketch[: counts[k]] = folded[first[k] : first[k + 1]]
        found.append((key[first[k] : min(first[k] + apart + 1, first[k + 1])], sketch))
    return found


def _batches(text: pa.Array, hasher: Hasher) -> Iterator[np.ndarray]:
    for value in text:
        yield hasher.shingles(value.as_py())


def _sets(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, key of the text, size of its set and its 128 bits (node, check) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width, seed)
        for batch in batches:
            rows = [(len(s), *digest(s)) for s in _batches(batch.column("text"), hasher)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], ["doc_id", "key", "n", "node", "check"])

    rest = StructType.fromDDL("key long, n long, node long, check long")
    return _keyed(docs, "doc_id").mapInArrow(run, StructType([docs.schema["doc_id"], *rest.fields]))


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("key"), text.alias("text"))


def _frequent(docs: DataFrame, total: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a hash-picked sample share, rising, and in how many."""
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    place = F.pmod(F.xxhash64("key", F.lit("order")), F.lit(1 << 20))
    picked = _keyed(docs).where(place < int(share * (1 << 20)) + 1).dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width, seed)
        for batch in batches:
            for found in _batches(batch.column("text"), hasher):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    counted = picked.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    rows = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT_ROWS).toArrow()
    names = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], rows.column("n").to_numpy()[order]


def _block_rows(docs: DataFrame, frequent, width: int, seed: int, percent: int) -> DataFrame:
    """(node, band, n, keys, sketch) of every text and band; a text repeated in a task comes once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["node", "band", "n", "keys", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(width, seed), set()
        wait: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            sets, nodes, bands, aparts = zip(*wait)
            parts = blocks(list(sets), list(bands), list(aparts), shared.value)
            columns = (nodes, bands, [len(s) for s in sets], [k.view(np.int64) for k, _ in parts], [f.view(np.int64) for _, f in parts])
            wait.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("text")):
                if key in seen:
                    continue
                if len(seen) > CACHE_ROWS:
                    seen.clear()
                seen.add(key)
                found = hasher.shingles(value.as_py())
                for band, apart in bands_of(len(found), percent):
                    wait.append((found, digest(found)[0], band, apart))
                    held += len(found)
                if held > BLOCKED_AT_ONCE:
                    yield made()
                    held = 0
        if wait:
            yield made()

    return _keyed(docs).mapInArrow(run, "node long, band int, n long, keys array<long>, sketch array<long>")


def _differing(one: str, other: str):
    bits = F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, b: total + b)


def _may_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Distinct (u, v) of pairs (band, u, v) whose folded sketches differ in no more bits than similar sets may."""
    side = lambda name: sketches.select("band", F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    both = pairs.distinct().join(side("u"), ["band", "u"]).join(side("v"), ["band", "v"])
    apart = F.lit(100 - percent) * (F.col("n_u") + F.col("n_v"))
    fits = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    return both.where(fits & (_differing("s_u", "s_v") * (100 + percent) <= apart)).select("u", "v").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, width: int, seed: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose whole sets have the similarity.

    Only texts in pairs are read for their sets. A set meets its partners' in salted shares of a
    bounded number of shingles, so a text with many partners is no hot key.
    """
    pairs = materialize(pairs)
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(texts, "node").select("key")
    chosen = _keyed(docs).join(small_side(materialize(wanted), BROADCAST_ROWS), "key", "left_semi").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width, seed)
        for batch in batches:
            for found in _batches(batch.column("text"), hasher):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(found)[0]], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], ["node", "held"]
                )

    sets = materialize(chosen.mapInArrow(run, "node long, held array<long>").dropDuplicates(["node"]))
    let_go(docs.sparkSession)
    load = pairs.join(sets.select(F.col("node").alias("v"), F.size("held").alias("n")), "v").groupBy("u").agg(F.sum("n").alias("load"))
    shares = load.select("u", F.ceil(F.col("load") / SHARE_SHINGLES).cast("int").alias("shares"))
    placed = pairs.join(shares, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("shares")).cast("int"))
    own = sets.join(shares, F.col("node") == F.col("u")).select("u", F.col("held").alias("one"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"))
    partners = placed.join(sets.select(F.col("node").alias("v"), F.col("held").alias("other")), "v")
    met = partners.join(own, ["u", "salt"]).select("u", "v", F.size("one").alias("a"), F.size("other").alias("b"), F.size(F.array_intersect("one", "other")).alias("both"))
    return met.where(100 * F.col("both") >= percent * (F.col("a") + F.col("b") - F.col("both"))).select("u", "v")


def _apart_in_crowds(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(band, u, v) of documents of one crowded key, different components, and sketches that may link.

    Members (key, band, node, root) are dealt into blocks by hash; every two blocks of a key meet in one group.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / CROWD_BLOCK).cast("int").alias("parts"))
    dealt = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(F.least(p, F.col("part")).alias("low"), F.greatest(p, F.col("part")).alias("high")),
    )
    met = dealt.join(sketches, ["band", "node"]).withColumn("cell", F.explode(others))

    def run(key: tuple, part: pa.Table) -> pa.Table:
        nodes, roots, n, own = (part.column(c).to_numpy() for c in ("node", "root", "n", "part"))
        marks = np.array(part.column("sketch").to_pylist(), dtype=np.int64).view(np.uint64)  # counting bits takes signed numbers for their size
        low, high = key[1].as_py(), key[2].as_py()
        rows, columns = np.flatnonzero(own == low), np.flatnonzero(own == high)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in rows:
            with_ = columns[(roots[columns] != roots[r]) & ((low != high) | (columns > r))]
            if not len(with_):
                continue
            bits = np.bitwise_count(marks[with_] ^ marks[r]).sum(axis=1, dtype=np.int64)
            fits = bits * (100 + percent) <= (100 - percent) * (n[with_] + n[r])
            fits &= 100 * np.minimum(n[with_], n[r]) >= percent * np.maximum(n[with_], n[r])
            us.append(np.full(fits.sum(), nodes[r]))
            vs.append(nodes[with_[fits]])
        u, v = np.concatenate(us), np.concatenate(vs)
        band = np.full(len(u), part.column("band")[0].as_py(), np.int32)
        return pa.table({"band": band, "u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    cells = met.select("key", F.col("cell.low").alias("low"), F.col("cell.high").alias("high"), "band", "node", "root", "n", "part", "sketch")
    return cells.groupBy("key", "low", "high").applyInArrow(run, "band int, u long, v long")


def linked(docs: DataFrame, texts: DataFrame, frequent, width: int, seed: int, percent: int) -> DataFrame:
    """(node, root): every linked set with the least node that it reaches. ``texts`` has (node, key)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "blocks")
    _block_rows(docs, frequent, width, seed, percent).write.parquet(path)
    made = spark.read.parquet(path)
    sketches = made.dropDuplicates(["band", "node"]).select("band", "node", "n", "sketch")
    keyed = made.select("band", "node", F.explode("keys").alias("key"))
    met = keyed.groupBy("key", "band").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.count("*").alias("n"))
    met = materialize(met.where("u != v"))
    # two documents are a pair; of more, each is compared with the least
    members = materialize(keyed.join(small_side(met.where("n > 2").select("key", "u"), BROADCAST_ROWS), "key").distinct())
    pairs = met.where("n = 2").select("band", "u", "v").unionByName(
        members.where("node != u").select("band", "u", F.col("node").alias("v"))
    )
    let_go(spark)
    first = materialize(_verified(_may_link(pairs, sketches, percent), docs, texts, width, seed, percent))
    let_go(spark)
    roots = materialize(components(first))
    rooted = members.select("key", "band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("one"), F.max("root").alias("other")).where("n > 2 and one != other")
    open_ = materialize(rooted.join(apart.select("key", "n"), "key"))
    let_go(spark)
    if open_.isEmpty():
        return roots
    few = open_.where(F.col("n") <= CROWD)
    mates = few.select("key", F.col("node").alias("v"), F.col("root").alias("other"))
    left = few.select("key", "band", F.col("node").alias("u"), "root").join(mates, "key").where("u < v and root != other").select("band", "u", "v")
    crowds = _apart_in_crowds(open_.where(F.col("n") > CROWD).drop("n"), sketches, percent)
    later = _verified(_may_link(left.unionByName(crowds), sketches, percent), docs, texts, width, seed, percent)
    # the components found are links of their own
    later = materialize(later)
    let_go(spark)
    return roots if later.isEmpty() else components(later.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (least doc_id that links reach, itself included) of every row.

    A-Z count as a-z; words are runs of other characters than white space; a text of fewer than
    ``width`` words is one shingle. Null, empty and white texts have an empty set, are linked with nothing and are their own
    component. Repeated rows stay repeated. A null doc_id takes part through its text but names no component: one of
    only null ids has a null component_id. An empty table gives an empty result; further columns are ignored.
    """
    for seed in range(42, 50):
        marked = materialize(_sets(docs, width, seed))
        classes = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.min("check").alias("low"), F.max("check").alias("high")))
        if classes.where("low != high").isEmpty():  # else two sets share a node: hash anew
            break
    frequent = _frequent(docs, marked.count(), width, seed)
    let_go(docs.sparkSession)
    roots = linked(docs, classes.select("node", "key"), frequent, width, seed, percent)
    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = placed.join(named, "root").select("node", "component_id")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return marked.join(known, "node").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
