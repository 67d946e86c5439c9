"""Benchmark decontamination by SimHash windows, with Spark functions only.

A document is read in windows as long as a benchmark item, in words. A window's SimHash is compared with
the items' through a multi-index: fingerprints within ``RADIUS`` bits agree up to
``RADIUS // BLOCKS`` bits in one of ``BLOCKS`` equal blocks, so looking each block up with that tolerance
misses none of them. What is found is verified exactly: the weighted Jaccard similarity of the two
shingle sets, a shingle's weight being how often it occurs, must reach ``SIMILARITY``.

Not every window needs a fingerprint. One that shares too few shingles with the whole benchmark cannot
reach the similarity with any item; and of a run of windows the most similar ones include one that
starts with a shared shingle, for moving a window past an unshared one loses nothing. So windows
start at shared shingles, end with the text at the latest, and hold enough of them; this leaves out no match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import counted_small, let, small_side, words
from sitegauge.session import materialize

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
BLOCK_BITS = 8
#: Documents up to which the ids of those with enough shared shingles are broadcast.
BROADCAST_DOCS = 500_000


def normal_words(text: Column) -> Column:
    """Words of the text in lower case; none for null."""
    return words(F.lower(text.cast("string")))


def shingles(tokens: Column, width: int) -> Column:
    """Hashes of every run of ``width`` words, in order; none for fewer words."""

    def run(w: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
        )
        return F.when(F.size(w) >= width, each).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, run)


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of an array of hashes; a bit is set where over half of them have it.

    Each of 32 passes counts two bits, in the two halves of a long.
    """
    lanes, zero = F.lit(0x0000000100000001), F.lit(0).cast("long")

    def two_bits(h: Column, shift: int) -> Column:
        half = F.size(h) / 2
        counts = F.aggregate(h, zero, lambda total, x: total + F.shiftrightunsigned(x, shift).bitwiseAND(lanes))

        def bits(t: Column) -> Column:
            low = F.when(t.bitwiseAND(F.lit(0xFFFFFFFF)) > half, F.lit(_bit(shift))).otherwise(zero)
            high = F.when(F.shiftrightunsigned(t, 32) > half, F.lit(_bit(32 + shift))).otherwise(zero)
            return low.bitwiseOR(high)

        return let(counts, bits)

    return let(hashes, lambda h: reduce(Column.bitwiseOR, [two_bits(h, shift) for shift in range(32)]))


def _bit(at: int) -> int:
    return -(1 << 63) if at == 63 else 1 << at


def block_keys(fp: Column, near: bool) -> Column:
    """Array of (block, value) of a fingerprint; with ``near``, every value within the tolerance."""
    flips = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda x: F.bit_count(x) <= RADIUS // BLOCKS)
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))

    def value(b: Column) -> Column:
        moved = F.array(*(F.shiftrightunsigned(fp, k * BLOCK_BITS) for k in range(BLOCKS)))
        return F.get(moved, b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")

    if not near:
        return F.transform(blocks, lambda b: F.struct(b.alias("block"), value(b).alias("value")))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: let(
                value(b), lambda v: F.transform(flips, lambda x: F.struct(b.alias("block"), v.bitwiseXOR(x).alias("value")))
            ),
        )
    )


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, width, hashes, size): items with words; below WIDTH words the whole item is one shingle."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    found = [
        items.where(F.size("w") >= WIDTH if width == WIDTH else F.size("w") == width).select(
            "item_id", F.size("w").alias("n"), F.lit(width).alias("width"), shingles(F.col("w"), width).alias("hashes")
        )
        for width in range(1, WIDTH + 1)
    ]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.withColumn("size", F.size("hashes"))


def _shared(docs: DataFrame, items: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, width, at, h): where shingles of any item occur in a document."""
    known = items.select("width", F.explode("hashes").alias("h")).distinct()
    text = normal_words(F.col("text"))
    found = []
    for width in widths:
        each = docs.select("doc_id", shingles(text, width).alias("s"))
        placed = each.select("doc_id", F.posexplode("s").alias("at", "h"))
        own = known.where(F.col("width") == width).select("h")
        found.append(placed.join(small_side(own), "h").select("doc_id", F.lit(width).alias("width"), "at", "h"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every


def _windows(shared: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n, width, at, size): windows that start at a shared shingle and hold enough of them.

    Of the shared places of a document in order, the window holds enough if the one that many
    places further on is still inside it.
    """
    order = Window.partitionBy("doc_id", "width").orderBy("at", "h")
    ranked = shared.select("doc_id", "width", "at", "h").distinct().withColumn("rank", F.row_number().over(order))
    lengths = items.select("n", "width", "size", F.explode("hashes").alias("h")).distinct()
    need = F.ceil(SIMILARITY * F.col("size") - 1e-9).cast("int")
    starts = ranked.join(small_side(lengths), ["width", "h"]).select("doc_id", "width", "n", "at", "size", (F.col("rank") + need - 1).alias("rank"))
    further = ranked.select("doc_id", "width", "rank", F.col("at").alias("until"))
    held = starts.distinct().join(further, ["doc_id", "width", "rank"]).where(F.col("until") < F.col("at") + F.col("size"))
    return held.select("doc_id", "n", "width", "at", "size").distinct()


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, words): items that a document holds, at their best window.

    Of equally similar windows that start with a shared shingle the first is given, as its first word's
    place and its number of words.
    Null, empty and white-space texts hold nothing, on either side; items of fewer than five words are
    compared as one shingle. Repeated rows of one doc_id count as versions of one document and
    give one row an item; rows without a doc_id are not searched, as a finding could not name them
    (``clean`` judges them by their text). Empty tables give an empty result; further columns of
    either table are ignored.
    """
    named = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    items = materialize(item_table(benchmark))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    if not widths:
        return _nothing(docs, benchmark)
    shared = materialize(_shared(named, items, widths))
    windows = materialize(_windows(shared, items))
    return _verified(named, items, windows, widths)


def _nothing(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    ids = docs.select("doc_id").where("false").crossJoin(benchmark.select("item_id").where("false"))
    return ids.select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("first_word"), F.lit(0).alias("words"))


def _verified(docs: DataFrame, items: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    held = windows.select("doc_id").distinct()
    texts = docs.join(F.broadcast(held) if counted_small(held, BROADCAST_DOCS) else held, "doc_id", "left_semi")
    spans = windows.groupBy("doc_id", "width").agg(F.collect_set(F.struct("at", "n", "size")).alias("spans"))
    cut = None
    for width in widths:
        hashed = texts.select("doc_id", shingles(normal_words(F.col("text")), width).alias("s"))
        own = spans.where(F.col("width") == width).drop("width")
        part = hashed.join(own, "doc_id").select(
            "doc_id",
            F.lit(width).alias("width"),
            F.explode(
                F.transform(
                    "spans",
                    lambda w: F.struct(
                        w["at"].alias("at"), w["n"].alias("n"), F.slice(F.col("s"), w["at"] + 1, w["size"]).alias("hashes")
                    ),
                )
            ).alias("w"),
        )
        cut = part if cut is None else cut.unionByName(part)
    cut = cut.select("doc_id", "width", "w.*").where(F.size("hashes") > 0)
    # windows of equal content are fingerprinted and verified once
    content = F.md5(F.concat_ws(":", "width", "n", F.array_join("hashes", ",")))
    cut = materialize(cut.withColumn("content", content))
    distinct = cut.groupBy("content", "n", "width").agg(F.first("hashes").alias("hashes"))
    marked = materialize(distinct.withColumn("fp", simhash(F.col("hashes"))))
    prints = marked.select("n", "width", "fp").distinct().withColumn("k", F.explode(block_keys(F.col("fp"), near=False)))
    index = items.select("item_id", "n", "width", simhash(F.col("hashes")).alias("item_fp"))
    index = index.withColumn("k", F.explode(block_keys(F.col("item_fp"), near=True)))
    near = (
        prints.join(small_side(index), ["n", "width", "k"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
        .select("n", "width", "fp", "item_id")
        .distinct()
    )
    pairs = marked.join(near, ["n", "width", "fp"]).select("content", "width", "item_id", "hashes")
    similar = _similar(pairs, items)
    found = cut.select("doc_id", "content", "at", F.size("hashes").alias("held"), "width").join(similar, "content")
    best = F.max(F.struct("similarity", (-F.col("at")).alias("before"), (F.col("held") + F.col("width") - 1).alias("words")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.similarity", (-F.col("b.before")).alias("first_word"), "b.words"
    )


def _similar(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(content, check, item_id, similarity) of pairs whose weighted Jaccard similarity is high enough."""
    size = pairs.select("content", "item_id", F.size("hashes").alias("held"), F.explode("hashes").alias("h"))
    counts = size.groupBy("content", "item_id", "held", "h").agg(F.count("*").alias("here"))
    wanted = items.select("item_id", F.col("size").alias("want"), F.explode("hashes").alias("h"))
    wanted = wanted.groupBy("item_id", "want", "h").agg(F.count("*").alias("there"))
    both = counts.join(small_side(wanted), ["item_id", "h"])
    met = both.groupBy("content", "item_id", "held", "want").agg(F.sum(F.least("here", "there")).alias("met"))
    similarity = F.col("met") / (F.col("held") + F.col("want") - F.col("met"))
    return met.withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY).select(
        "content", "item_id", "similarity"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are.

    Rows without a doc_id go by their text.
    """
    key = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))))
    held = find(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(small_side(held), key == held["_held"], "left_anti")


#: The pairs by every window of every document, without fingerprints, in DuckDB's SQL.
ORACLE = """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM benchmark),
ish AS (SELECT item_id, len(w) AS n, array_to_string(w[i:i+4], ' ') AS s FROM iw, range(1, 1000) AS t(i) WHERE i <= len(w) - 4),
ic AS (SELECT item_id, n, n - 4 AS want, s, count(*) AS there FROM ish GROUP BY ALL),
dsh AS (SELECT doc_id, len(w) AS words, i AS pos, array_to_string(w[i:i+4], ' ') AS s FROM dw, range(1, 100000) AS t(i) WHERE i <= len(w) - 4),
hits AS (SELECT doc_id, words, pos, s FROM dsh WHERE s IN (SELECT s FROM ic)),
starts AS (SELECT DISTINCT h.doc_id, h.words, h.pos, c.item_id, c.n, c.want FROM hits h JOIN ic c USING (s)),
inside AS (
  SELECT a.doc_id, a.item_id, a.pos, a.want, least(a.want, a.words - 4 - a.pos + 1) AS held, h.s, count(*) AS here
  FROM starts a JOIN hits h ON h.doc_id = a.doc_id AND h.pos >= a.pos AND h.pos < a.pos + a.want GROUP BY ALL),
met AS (
  SELECT i.doc_id, i.item_id, i.pos, i.want, i.held, sum(least(i.here, c.there)) AS met
  FROM inside i JOIN ic c ON c.item_id = i.item_id AND c.s = i.s GROUP BY ALL),
scored AS (SELECT doc_id, item_id, pos, held, CAST(met AS DOUBLE) / (held + want - met) AS similarity FROM met)
SELECT doc_id, item_id, similarity, CAST(pos - 1 AS INTEGER) AS first_word, CAST(held + 4 AS INTEGER) AS words
FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, pos, held DESC) = 1
"""
