"""Quality rules: counted facts of a text, and a logistic regression over hashed n-grams.

Features are a text's letter triples, words, and pairs of neighbouring words, hashed into tables of
fixed size; each kind counts by its share of the text. A pair is hashed as the difference of its
words, so all repetitions of a word share one feature. The regression learns from a bounded
sample of labelled rows, a part of which is set aside to calibrate its probability, and scores Arrow
batches; a text is kept if the probability reaches a fixed threshold and no rule speaks against it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from sitegauge.llm.common import code_points, pieces

#: Buckets of one kind of feature, and the kinds: letter triples, words, pairs.
BUCKETS = 1 << 16
KINDS = 3
#: Labelled rows that the regression may see, and the share of them that calibrates it.
SAMPLE_ROWS = 4_000
CALIBRATION_SHARE = 4
ROUNDS = 40
KEEP_THRESHOLD = 0.3

# The rules' limits and the characters that count as symbols.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass
class Model:
    weights: np.ndarray  # KINDS * BUCKETS
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    empty: bool = False


def facts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur more than once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered += at + 3 - max(end, at)
            end = at + 3
    return covered


_powers = np.cumprod(np.full(256, 0x100000001B3, dtype=np.uint64), dtype=np.uint64)
_mix = np.uint64(0x9E3779B97F4A7C15)


def hashed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letter triples, of the words and of the pairs of a text, and where each word starts."""
    points = code_points(text).astype(np.uint64)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    spread = np.where(blank, np.uint64(32), points)
    triple = (spread[2:] + spread[1:-1] * np.uint64(0x10001) + spread[:-2] * np.uint64(0x100000007)) * _mix if len(points) > 2 else points[:0]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(start):
        none = np.zeros(0, np.int64)
        return (triple >> np.uint64(48)).astype(np.int64), none, none, start
    owner = np.cumsum(np.isin(np.arange(len(points)), start, assume_unique=True)) - 1
    place = (np.arange(len(points)) - start[np.maximum(owner, 0)]) % 256
    word = np.add.reduceat(np.where(blank, np.uint64(0), (points + np.uint64(1)) * _powers[place]), start)
    pair = (word[1:] - word[:-1]) * _mix
    shift = np.uint64(48)
    return tuple((x >> shift).astype(np.int64) for x in (triple, word * _mix, pair)) + (start,)


def _sums(model_weights: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Sum over kinds of the mean weight of each text's features."""
    totals, counts = np.zeros((len(texts), KINDS)), np.zeros((len(texts), KINDS))
    for group in pieces(texts):
        joined = "\n\n\n".join(p for _, p in group)
        edges = np.cumsum([0] + [len(p) + 3 for _, p in group])
        triple, word, pair, start = hashed(joined)
        cuts = np.searchsorted(start, edges)
        running = [np.concatenate([[0.0], np.cumsum(model_weights[k * BUCKETS + b])]) for k, b in enumerate((triple, word, pair))]
        for at, (row, piece) in enumerate(group):
            first, last = edges[at], edges[at] + len(piece)
            spans = ((first, max(last - 2, first)), (cuts[at], cuts[at + 1]), (cuts[at], max(cuts[at + 1] - 1, cuts[at])))
            for k, (a, b) in enumerate(spans):
                b = min(b, len(running[k]) - 1)
                totals[row, k] += running[k][b] - running[k][min(a, b)]
                counts[row, k] += max(b - a, 0)
    return (totals / np.maximum(counts, 1)).sum(axis=1)


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text: columns and values."""
    columns, values = [], []
    for k, buckets in enumerate(hashed(text)[:KINDS]):
        if len(buckets):
            at, n = np.unique(buckets, return_counts=True)
            columns.append(at + k * BUCKETS)
            values.append(n / len(buckets))
    if not columns:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(columns), np.concatenate(values)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most SAMPLE_ROWS labelled rows, picked by a hash of the doc_id."""
    spark = docs.sparkSession
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    picked = marks.withColumn("_order", order).orderBy("_order", "doc_id").limit(SAMPLE_ROWS)
    picked = picked.select(F.col("doc_id").alias("_labelled"), "quality", "_order").toArrow()
    if not picked.num_rows:
        return Model(np.zeros(0), empty=True)
    side = spark.createDataFrame(picked)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(side), F.col("doc_id") == F.col("_labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sparse(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_order"),
                    batch.column("y"),
                    pa.array([c for c, _ in made], pa.list_(pa.int32())),
                    pa.array([v for _, v in made], pa.list_(pa.float32())),
                ],
                ["_order", "y", "columns", "values"],
            )

    rows = rows.select("_order", F.col("quality").cast("int").alias("y"), "text")
    got = rows.mapInArrow(run, "_order long, y int, columns array<int>, values array<float>").toArrow().sort_by("_order")
    y = got.column("y").to_numpy().astype(float)
    lists = got.column("columns").combine_chunks()
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    columns, values = lists.flatten().to_numpy(), got.column("values").combine_chunks().flatten().to_numpy().astype(float)
    return _train(y, ends, columns, values)


def _train(y: np.ndarray, ends: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Model:
    aside = np.arange(len(y)) % CALIBRATION_SHARE == 0
    if not 0 < y[~aside].sum() < (~aside).sum():
        return Model(np.zeros(0), empty=True)
    weights, seen = np.zeros(KINDS * BUCKETS), np.full(KINDS * BUCKETS, 1e-6)
    bias = float(np.log(y[~aside].mean() / (1 - y[~aside].mean())))
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for rows in np.array_split(rng.permutation(np.flatnonzero(~aside)), max(1, (~aside).sum() // 200)):
            sizes = ends[rows + 1] - ends[rows]
            at = np.repeat(ends[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            owner = np.repeat(np.arange(len(rows)), sizes)
            logit = np.bincount(owner, weights=weights[columns[at]] * values[at], minlength=len(rows)) + bias
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]
            slope = np.bincount(columns[at], weights=error[owner] * values[at], minlength=len(weights)) / len(rows)
            seen += slope * slope
            weights -= slope / np.sqrt(seen)
            bias -= 0.1 * error.mean()
    rows = np.flatnonzero(aside)
    x = np.array([(weights[columns[ends[r] : ends[r + 1]]] * values[ends[r] : ends[r + 1]]).sum() + bias for r in rows])
    model = Model(weights.astype(np.float32), bias)
    if 0 < y[rows].sum() < len(rows):
        model.slope, model.shift = _platt(x, y[rows])
    return model


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    design, fitted = np.stack([x, np.ones(len(x))], axis=1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ fitted, -30, 30)))
        slope = design.T @ (p - y) + 1e-2 * fitted
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2
        fitted -= np.clip(np.linalg.solve(curve, slope), -1, 1)
    return float(fitted[0]), float(fitted[1])


def probabilities(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.empty:
        return np.ones(len(texts))
    x = _sums(model.weights, texts) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * x + model.shift, -30, 30)))


def judge(docs: DataFrame, model: Model, threshold: float = KEEP_THRESHOLD) -> DataFrame:
    """doc_id, the counted facts, base_failed, kept and quality (0 to 1) of every row.

    A null text has no words, so the rules fail it like an empty one. Without labelled rows of both
    kinds quality is 1 and the rules decide alone. Repeated rows stay repeated, a null doc_id stays
    null, an empty table gives an empty result, further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            counted = np.array([facts(t) for t in texts], dtype=np.int64).reshape(-1, len(names))
            failed = (counted[:, 0] < LEAST_WORDS) | (100 * counted[:, 4] > MOST_REPEATED_PERCENT * counted[:, 0])
            quality = probabilities(shared.value, texts)
            columns = [pa.array(counted[:, k]) for k in range(len(names))]
            columns += [pa.array(failed), pa.array(~failed & (quality >= threshold)), pa.array(quality, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names, "base_failed", "kept", "quality"])

    schema = StructType([docs.schema["doc_id"]])
    for name in names:
        schema = schema.add(name, LongType())
    schema = schema.add("base_failed", BooleanType()).add("kept", BooleanType()).add("quality", DoubleType())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
