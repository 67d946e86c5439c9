"""Language identification: scripts narrow the candidates, a Viterbi path labels the words.

Every word has a score for each language, the log-likelihood of its letters given the two before,
from counts over all training documents. The script of a word's first letter rules out languages
that are hardly written in it; a rare language keeps its scripts, however much of a script is another's. The best path through the words pays a penalty for each
switch of language, so a text of several languages falls into spans and a stray word
does not. The document's language is the one with most letters on the path, its score their share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from sitegauge.llm.common import code_points, crc_remainder, pieces

#: Buckets of hashed letter triples.
BUCKETS = 1 << 16
SWITCH_PENALTY = 8.0
#: A language stays a candidate for a script that has this share of the language's own letters.
SCRIPT_SHARE = 0.001
PRIOR = 0.1
#: Score of a language that a word's script rules out; finite, so that sums keep what comes after.
RULED_OUT = -1e6
UNKNOWN = "und"

# First code points of script ranges, and the script that starts there (0: none).
SCRIPTS = ((0x0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x900, 7), (0xE00, 8), (0xE80, 9),
           (0x10A0, 10), (0x1100, 11), (0x1200, 12), (0x1E00, 1), (0x1F00, 2), (0x2C80, 9), (0x3040, 13), (0x3100, 11),
           (0x3400, 14), (0xAC00, 11), (0xD7B0, 9), (0xF900, 14), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFF00, 1),
           (0xFF66, 13), (0x10000, 9), (0x20000, 14), (0x30000, 14))
N_SCRIPTS = 15


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # N_SCRIPTS x languages, 0 or RULED_OUT


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


_STARTS = np.array([s for s, _ in SCRIPTS], dtype=np.uint32)
_NAMES = np.array([n for _, n in SCRIPTS], dtype=np.int64)


def triples(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased text: bucket of each letter with the two before it in its word; place of each; where words begin among them; script of each word."""
    points = code_points(text)
    letter = _is_letter()[points]
    places = np.flatnonzero(letter)
    if not len(places):
        none = np.zeros(0, np.int64)
        return none, places, none, none
    seen = np.where(letter, points, 0).astype(np.uint64)
    one, two = np.concatenate([[0], seen[:-1]]).astype(np.uint64), np.concatenate([[0, 0], seen[:-2]]).astype(np.uint64)[: len(seen)]
    two = np.where(one == 0, 0, two)  # nothing before the word counts
    mixed = (two * np.uint64(0x9E3779B1) + one * np.uint64(0x85EBCA77) + seen * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    buckets = (mixed[places] >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
    first = np.flatnonzero(one[places] == 0)
    scripts = _NAMES[np.searchsorted(_STARTS, points[places[first]], side="right") - 1]
    return buckets, places, first, scripts


def fit(docs: DataFrame) -> Model:
    """Counts letters by language over all documents with a lang whose crc32(doc_id) mod 4 is not 2."""
    chosen = docs.where("lang is not null and text is not null").where(crc_remainder(F.col("doc_id"), 4) != 2)
    chosen = chosen.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = [t.as_py() for t in batch.column("text")]
            for lang in set(langs):
                total = counts.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for group in pieces([t for t, own in zip(texts, langs) if own == lang]):
                    text = "\n".join(p for _, p in group).lower()
                    buckets, places, first, scripts = triples(text)
                    total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    if len(first):
                        sizes = np.diff(np.append(first, len(buckets)))
                        total[BUCKETS:] += np.bincount(scripts, weights=sizes, minlength=N_SCRIPTS).astype(np.int64)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "at", "n"])

    rows = chosen.mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    which = np.searchsorted(languages, rows.column("lang").to_pylist()) if languages else np.zeros(0, int)
    counts[rows.column("at").to_numpy(), which] = rows.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    smooth = grams + PRIOR
    scores = np.log(smooth / smooth.sum(axis=0, keepdims=True)) if languages else smooth
    scores = (scores - scores.mean(axis=1, keepdims=True)).astype(np.float32) if languages else scores.astype(np.float32)
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    narrowed = np.where(share >= SCRIPT_SHARE, 0.0, RULED_OUT)
    narrowed[~(share >= SCRIPT_SHARE).any(axis=1)] = 0.0  # a script that no language showed leaves all
    return Model(languages, scores, narrowed)


def best_path(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Language of each word: the path of greatest score less a penalty for every switch; ties go to the earlier language."""
    words, languages = scores.shape
    whole = scores.sum(axis=0)
    best = int(np.argmax(whole))
    # no excursion from the best language pays for half a switch: the path never leaves it
    gain = np.zeros((words + 1, languages))
    np.cumsum(scores - scores[:, best : best + 1], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(words, best)
    came = np.zeros((words, languages), dtype=np.int32)
    rows = scores.tolist()
    now = list(rows[0])
    everyone = range(languages)
    for word in range(1, words):
        top = max(everyone, key=now.__getitem__)
        change = now[top] - penalty
        before, row = now, rows[word]
        now = [max(before[k], change) + row[k] for k in everyone]
        came[word] = [k if before[k] >= change else top for k in everyone]
    path = np.zeros(words, dtype=np.int64)
    path[-1] = max(everyone, key=now.__getitem__)
    for word in range(words - 1, 0, -1):
        path[word - 1] = came[word, path[word]]
    return path


def label_words(model: Model, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: first code point, letters and language of each of its words, in the lower-cased text."""
    held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in texts]
    passed = [0] * len(texts)
    for group in pieces(texts):
        lowered = [p.lower() for _, p in group]
        edges = np.cumsum([0] + [len(p) + 1 for p in lowered])
        buckets, places, first, scripts = triples("\n".join(lowered))
        sizes = np.diff(np.append(first, len(buckets)))
        if len(first):
            scores = np.add.reduceat(model.scores[buckets], first, axis=0).astype(np.float64) + model.allowed[scripts]
        cuts = np.searchsorted(places[first], edges) if len(first) else np.zeros(len(edges), int)
        for at, (row, _) in enumerate(group):
            own = slice(cuts[at], cuts[at + 1])
            if own.stop > own.start:
                held[row].append((places[first[own]] - edges[at] + passed[row], sizes[own], scores[own]))
            passed[row] += len(lowered[at])
    for parts in held:
        if not parts:
            none = np.zeros(0, np.int64)
            yield none, none, none
            continue
        starts, sizes, scores = (np.concatenate([p[k] for p in parts]) for k in range(3))
        yield starts, sizes, best_path(scores)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was
    learnt. Repeated rows stay repeated, a null doc_id stays null, an empty table gives an empty
    result, further columns are ignored. Texts of any length are read whole, in bounded pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names, scores = [], []
            texts = [t.as_py() for t in batch.column("text")] if own.languages else []
            for _, sizes, path in label_words(own, texts):
                letters = np.bincount(path, weights=sizes, minlength=1) if len(path) else np.zeros(1)
                total = letters.sum()
                names.append(own.languages[int(np.argmax(letters))] if total else UNKNOWN)
                scores.append(float(letters.max() / total) if total else 0.0)
            if not own.languages:
                names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = StructType([docs.schema["doc_id"]]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
