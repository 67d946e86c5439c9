"""Toxicity by two class-conditional Kneser-Ney models of spelled words.

Each class (ordinary, toxic) has an interpolated model that spells every word to its end, a letter
given the ``ORDER - 1`` before it. Its counts are absolutely discounted, and what the discounts free goes to one
distribution that both classes share: their pooled counts, backed off through continuation
counts (in how many longer contexts a letter follows) of ever shorter contexts. The larger class's
counts are scaled to the smaller's size, so that neither has more to discount. An expression too
rare to tell anything so has the same probability in both and does not move the score.

A toxic text is mostly ordinary words: its likelihood is that of a mixture, a share ``TOXIC_SHARE`` of
the words from the toxic model and the rest from the ordinary one. The difference of the two
log-likelihoods is divided by the number of words and calibrated by logistic regression on labelled rows
that the counts leave out.

What the class counts tell nothing about needs no entry: its ratio is its context's. Of the entries
the weightiest are broadcast, with a bit map of the others; words that may meet those are gathered
once each and joined with the whole table, so no entry is left out, whatever their number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegauge.llm.common import crc_remainder, small_side
from sitegauge.session import materialize

#: Letters of a gram: one, and those before it in its word.
ORDER = 7
DISCOUNT = 0.75
SHARED_DISCOUNT = 0.75
#: Kinds of letters that a text may go on with where nothing is known.
LETTERS = 100
#: Share of a toxic text's words that are from the toxic model.
TOXIC_SHARE = 0.01
#: Entries that are broadcast, 12 bytes each, the weightiest first; and words of 64 bits that tell of the others.
HELD_ROWS = 1 << 21
MAP_ROWS = 1 << 20
#: Labelled rows left out of the counts: one of so many; and how many of them fit the calibration.
CALIBRATION_SHARE = 8
CALIBRATION_ROWS = 50_000
#: Entries of a worker's word cache and of its counts before they are handed on.
CACHE_ROWS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_SEED = 42  # of Spark's xxhash64


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """Held entries by rising key, and calibration; if not all are held, the bit map of the others and the whole table."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    slope: float = 1.0
    shift: float = 0.0
    empty: bool = False
    others: np.ndarray | None = None
    table: DataFrame | None = None


def _count_words(labelled: DataFrame) -> DataFrame:
    """(word, c0, c1): occurrences in each class, of rows (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def emit() -> Iterator[pa.RecordBatch]:
            for label, counts in enumerate(held):
                own, zeros = pa.array(list(counts.values()), pa.int64()), pa.array(np.zeros(len(counts), np.int64))
                pair = [own, zeros] if label == 0 else [zeros, own]
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *pair], ["word", "c0", "c1"])
                counts.clear()

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                held[label].update(words(text.as_py()))
                if len(held[label]) > CACHE_ROWS:
                    yield from emit()
        yield from emit()

    rows = labelled.mapInArrow(run, "word string, c0 long, c1 long")
    return rows.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _spelled(word: Column) -> Column:
    """The word's grams: each letter and the end mark with up to ORDER - 1 letters before, the start mark among them."""
    whole = F.concat(F.lit("^"), word, F.lit("$"))
    ends = F.sequence(F.lit(2), F.char_length(whole))
    return F.transform(ends, lambda i: F.substring(whole, F.greatest(F.lit(1), i - (ORDER - 1)), F.least(i, F.lit(ORDER))))


def _context(gram: str = "gram") -> Column:
    return F.substring(gram, F.lit(1), F.char_length(gram) - 1)


def _suffix(gram: str = "gram") -> Column:
    return F.substring(gram, F.lit(2), F.char_length(gram))


def _shorter(grams: DataFrame) -> DataFrame:
    """(gram, low): probability of the last letter after the others, by continuation counts, of all proper suffixes."""
    by_length, longer = {}, None
    for length in range(ORDER, 0, -1):
        own = grams.where(F.char_length("gram") == length).select("gram")
        every = own if longer is None else own.unionByName(longer.select("gram")).distinct()
        if longer is not None:
            by_length[length] = longer
        longer = materialize(every.select(_suffix().alias("gram")).groupBy("gram").agg(F.count("*").alias("k")))
    known, low = [], None
    for length in range(1, ORDER):
        counts = by_length[length].withColumn("context", _context())
        after = counts.groupBy("context").agg(F.sum("k").alias("total"), F.sum(F.least(F.col("k").cast("double"), F.lit(SHARED_DISCOUNT))).alias("freed"))
        rows = counts.join(after, "context")
        if low is None:
            rows = rows.withColumn("less", F.lit(1.0 / LETTERS))
        else:
            rows = rows.withColumn("suffix", _suffix()).join(low.select(F.col("gram").alias("suffix"), F.col("low").alias("less")), "suffix")
        low = materialize(rows.select("gram", ((F.greatest(F.col("k") - SHARED_DISCOUNT, F.lit(0.0)) + F.col("freed") * F.col("less")) / F.col("total")).alias("low")))
        known.append(low)
    every = known[0]
    for part in known[1:]:
        every = every.unionByName(part)
    return every


def _entries(counts: DataFrame) -> DataFrame:
    """(key, value, weight): log ratios of grams and, for letters not counted after them, of contexts.

    Keys are hashes of ``g`` and the gram or ``c`` and the context. A gram whose counts are all discounted has its context's ratio and no entry.
    """
    total = counts.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1")).first()
    least = min(total["n0"], total["n1"])
    each = counts.select(F.explode(_spelled(F.col("word"))).alias("gram"), *(F.col(f"c{k}") * F.lit(least / total[f"n{k}"]) for k in (0, 1))).toDF("gram", "c0", "c1")
    grams = materialize(each.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).withColumn("context", _context()))
    freed = lambda c, d: F.sum(F.least(c, F.lit(d)))
    both = F.col("c0") + F.col("c1")
    after = grams.groupBy("context").agg(
        *(F.sum(f"c{k}").alias(f"total{k}") for k in (0, 1)),
        *(freed(F.col(f"c{k}"), DISCOUNT).alias(f"freed{k}") for k in (0, 1)),
        F.sum(both).alias("total"),
        freed(both, SHARED_DISCOUNT).alias("freed"),
    )
    after = materialize(after)
    low = _shorter(grams).select(F.col("gram").alias("suffix"), "low")
    known = grams.where(F.greatest("c0", "c1") > DISCOUNT).join(after, "context").withColumn("suffix", _suffix()).join(low, "suffix")
    shared = (F.greatest(both - SHARED_DISCOUNT, F.lit(0.0)) + F.col("freed") * F.col("low")) / F.col("total")
    known = known.withColumn("shared", shared)
    likely = [
        F.when(F.col(f"total{k}") > 0, (F.greatest(F.col(f"c{k}") - DISCOUNT, F.lit(0.0)) + F.col(f"freed{k}") * F.col("shared")) / F.col(f"total{k}")).otherwise(F.col("shared"))
        for k in (0, 1)
    ]
    kept = [F.when(F.col(f"total{k}") > 0, F.col(f"freed{k}") / F.col(f"total{k}")).otherwise(1.0) for k in (0, 1)]
    steps = known.select(F.xxhash64(F.concat(F.lit("g"), "gram")).alias("key"), (F.ln(likely[1]) - F.ln(likely[0])).alias("value"), F.greatest("c0", "c1").alias("most"))
    unseen = after.select(F.xxhash64(F.concat(F.lit("c"), "context")).alias("key"), (F.ln(kept[1]) - F.ln(kept[0])).alias("value"), F.greatest("total0", "total1").alias("most"))
    entries = steps.unionByName(unseen.where("value != 0"))
    return entries.select("key", F.col("value").cast("float").alias("value"), F.floor(8 * F.log2("most")).cast("int").alias("weight"))


def _held_model(entries: DataFrame) -> Model:
    """Holds all entries from a weight on, as many as HELD_ROWS allow, and of the others a bit map and the table."""
    least, taken = None, 0
    for row in sorted(entries.groupBy("weight").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["weight"]):
        if taken + row["n"] > HELD_ROWS:
            least = row["weight"] + 1
            break
        taken += row["n"]
    held = (entries if least is None else entries.where(F.col("weight") >= least)).select("key", "value").toArrow()
    order = np.argsort(held.column("key").to_numpy())
    model = Model(held.column("key").to_numpy()[order], held.column("value").to_numpy()[order])
    if least is not None:
        bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(key, 32), 64) as int))")
        marks = entries.where(F.col("weight") < least).groupBy(F.pmod("key", F.lit(MAP_ROWS)).alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()
        model.others = np.zeros(MAP_ROWS, np.int64)
        model.others[marks.column("place").to_numpy()] = marks.column("bits").to_numpy()
        model.table = entries.select("key", "value")
    return model


def _word_values(found: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of each word by the held entries, and whether it may meet an entry that is not held."""
    digest, names = xxhash.xxh64_intdigest, []
    lengths = np.empty(len(found), np.int64)
    for k, word in enumerate(found):
        whole = f"^{word}$"
        lengths[k] = len(whole) - 1
        for end in range(2, len(whole) + 1):
            gram = whole[max(0, end - ORDER) : end]
            names.append(digest("g" + gram, _SEED))
            names.append(digest("c" + gram[:-1], _SEED))
    keys = np.array(names, np.uint64).view(np.int64)
    place = np.searchsorted(model.keys, keys)
    place[place == len(model.keys)] = 0
    known = model.keys[place] == keys if len(model.keys) else np.zeros(len(keys), bool)
    value = np.where(known, model.values[place] if len(model.keys) else 0.0, 0.0).astype(float)
    step = np.where(known[0::2], value[0::2], value[1::2])
    starts = np.cumsum(lengths) - lengths
    ratios = np.add.reduceat(step, starts) if len(step) else np.zeros(0)
    if model.others is None:
        return ratios, np.zeros(len(found), bool)
    met = (model.others[keys & (MAP_ROWS - 1)] >> ((keys >> 32) & 63)) & 1
    return ratios, np.add.reduceat(met[0::2] + met[1::2], starts) > 0 if len(step) else np.zeros(0, bool)


def word_score(ratio):
    """What a word adds to the log-likelihood of a toxic text over an ordinary one, in shares of a toxic word."""
    return np.log1p(TOXIC_SHARE * np.expm1(np.minimum(ratio, 500.0))) / TOXIC_SHARE


def _scorer(model: Model):
    cache: dict[str, float | None] = {}

    def score(texts: list[str | None]) -> list[tuple[float, int, list[tuple[str, int]]]]:
        """Of each text the sum over words, their number, and the words whose entries are not all held."""
        counted = [Counter(words(t)) for t in texts]
        if len(cache) > CACHE_ROWS:
            cache.clear()
        missing = [w for w in set().union(*counted) if w not in cache]
        for start in range(0, len(missing), 10_000):
            chunk = missing[start : start + 10_000]
            ratios, beyond = _word_values(chunk, model)
            cache.update((w, None if b else v) for w, v, b in zip(chunk, word_score(ratios).tolist(), beyond))
        out = []
        for own in counted:
            total, rest = 0.0, []
            for word, times in own.items():
                if (value := cache[word]) is None:
                    rest.append((word, times))
                else:
                    total += times * value
            out.append((total, own.total(), rest))
        return out

    return score


def _joined_values(rest: DataFrame, table: DataFrame) -> DataFrame:
    """(word, value) of words by the whole table."""
    grams = rest.select("word", F.posexplode(_spelled(F.col("word"))).alias("place", "gram"))
    keyed = grams.select("word", F.xxhash64(F.concat(F.lit("g"), "gram")).alias("key"), F.xxhash64(F.concat(F.lit("c"), _context())).alias("other"))
    met = keyed.join(table, "key", "left").join(table.select(F.col("key").alias("other"), F.col("value").alias("unseen")), "other", "left")
    ratio = met.groupBy("word").agg(F.sum(F.coalesce("value", "unseen", F.lit(0.0))).alias("r"))
    return ratio.select("word", (F.log1p(TOXIC_SHARE * F.expm1(F.least("r", F.lit(500.0)))) / TOXIC_SHARE).alias("value"))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _ratios_of(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with their texts' key and x, the difference of log-likelihoods over the number of words, in place of text."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, table=None))
    carried = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_texts = _scorer(shared.value)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                found = score_texts([t.as_py() for t in part.column("text")])
                rest = [[{"word": w, "times": n} for w, n in r] for _, _, r in found]
                kind = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
                columns = [pa.array([t for t, _, _ in found], pa.float64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array(rest, kind)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*carried, "_key")), *columns], [*carried, "_key", "_total", "_n", "_rest"])

    keyed = rows.withColumn("_key", _text_key(F.col("text")))
    found = StructType.fromDDL("_total double, _n long, _rest array<struct<word:string,times:long>>")
    schema = StructType([*(rows.schema[c] for c in carried), keyed.schema["_key"], *found.fields])
    parts = keyed.select(*carried, "text", "_key").mapInArrow(run, schema)
    total = F.col("_total")
    if model.table is not None:
        parts = materialize(parts.withColumn("_row", F.monotonically_increasing_id()))
        rest = parts.select("_row", F.explode("_rest").alias("w")).select("_row", "w.*")
        values = materialize(_joined_values(rest.select("word").distinct(), model.table))
        added = rest.join(small_side(values, 100_000), "word").groupBy("_row").agg(F.sum(F.col("times") * F.col("value")).alias("_added"))
        parts = parts.join(added, "_row", "left")
        total = total + F.coalesce("_added", F.lit(0.0))
    return parts.select(*carried, "_key", F.when(F.col("_n") > 0, total / F.col("_n")).otherwise(0.0).alias("x"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibration, by damped Newton steps."""
    design = np.stack([x, np.ones(len(x))], axis=1)
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (p - y) + 1e-3 * weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-3
        weights -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(weights[0]), float(weights[1])


def labelled_rows(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(text, toxic, calibrates, place) of training rows, place by a hash of the doc_id. A document with several labels takes the largest."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out).select(F.col("doc_id").alias("_labelled"), "toxic")
    rows = docs.select("doc_id", "text").join(small_side(marks), F.col("doc_id") == F.col("_labelled"))
    aside = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(CALIBRATION_SHARE)) == 0
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("place")), F.lit(1 << 20))
    return rows.select(
        F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"), aside.alias("calibrates"), place.alias("place")
    )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from all labelled rows whose crc32(doc_id) mod 5 is not 0, counts by Spark."""
    rows = labelled_rows(docs, labels, crc_remainder(F.col("doc_id"), 5) == 0)
    counts = materialize(_count_words(rows.where("not calibrates").select("text", "toxic")))
    if not counts.where("c1 > 0").head(1) or not counts.where("c0 > 0").head(1):
        return Model(empty=True)
    model = _held_model(materialize(_entries(counts)))
    aside = rows.where("calibrates")
    share = min(1.0, CALIBRATION_ROWS / max(aside.count(), 1))
    chosen = aside.where(F.col("place") < int(share * (1 << 20)))
    fitted = _ratios_of(chosen.select("toxic", "text"), model).select("x", "toxic").toArrow()
    y = fitted.column("toxic").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        model.slope, model.shift = _logistic(fitted.column("x").to_numpy(), y)
    return model


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with their texts' key and score in place of text."""
    if model.empty:
        return rows.select(*(c for c in rows.columns if c != "text"), _text_key(F.col("text")).alias("_key"), F.lit(0.0).alias("score"))
    logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.slope * F.col("x") + model.shift))
    return _ratios_of(rows, model).withColumn("score", 1 / (1 + F.exp(-logit))).drop("x")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``.

    Null and empty texts, and those without a letter, get the score of a text that says nothing.
    Without labelled rows of both classes every score is 0. Repeated rows stay repeated; a null
    doc_id stays null; further columns are ignored; an empty table gives an empty result.
    """
    return _scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", "score")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are, whatever their names.

    Null, empty and letterless texts have the score of a text that says nothing. Repeated rows stay
    repeated or go together. An empty table gives an empty result.
    """
    scored = _scored(docs.select(F.col("text").cast("string").alias("text")), model)
    toxic = materialize(scored.where(F.col("score") >= threshold).select(F.col("_key").alias("_toxic_key")).distinct())
    return docs.join(small_side(toxic), _text_key(docs["text"]) == toxic["_toxic_key"], "left_anti")
