"""Tokens of two tokenizers over the same text, aligned where both end.

A is a byte-level BPE file, B a sentencepiece file. The character offsets of A's tokens and the spans of
B's are the coarse cuts: places where a token of A and a token of B end together. Neither
tells the bytes inside a character that a tokenizer splits: all of A's parts of one claim the whole
character, and of B's byte tokens only the last has a width. So a segment with more than ASCII or
with byte tokens is cut where the decoded bytes of both tokenizers end together.

A text is aligned in segments, cut before every single space between two other characters. No token of
either vocabulary goes on over such a place (``Aligner`` looks; if one does, texts stay whole), so
the segments' tokens are the text's, and frequent segments are kept by the worker process.

How many documents hold an id pair linked is counted over the whole corpus. The pairs that most
documents hold are broadcast, up to a bound; the others are joined with, so every link is judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegauge.llm import workers
from sitegauge.session import materialize, scratch_path

#: Segments that a worker process keeps, and the longest of them in characters.
CACHE_ROWS = 500_000
LONGEST_KEPT = 48
#: Characters of texts whose segments are looked up together.
BATCH_CHARS = 1 << 20
#: Characters of segments that are aligned together.
SEGMENT_CHARS = 1 << 16
#: Id pairs that are broadcast, 17 bytes each; the others are joined with.
HEAD_ROWS = 1 << 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
_CROSSES = re.compile("[^▁]▁")


def byte_alphabet() -> dict[str, int]:
    """Byte of each letter that byte-level entries are spelled with: printable bytes are themselves, others follow 255."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Aligns texts; one for each pair of files and worker process, see ``aligner``."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = workers.byte_level(a_path, plain_specials=True), workers.pieces(b_path)
        letters = byte_alphabet()
        self.a_bytes = {i: bytes(letters.get(c, 0x3F) for c in entry) for entry, i in self.a.get_vocab().items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_single = np.array([self.b.is_byte(i) for i in range(len(names))])
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b_single[i] else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a_lengths = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, own in self.a_bytes.items():
            self.a_lengths[i] = len(own)
        self.b_lengths = np.array([len(own) for own in self.b_bytes])
        self.width = len(names)
        self.cuts = not any(_CROSSES.search(n) for n in names)
        #: Every id as text with what follows it, at 4 times the id plus the follower's place in this string.
        self.spelled = [f"{i}{after}" for i in range(max(len(self.a_lengths), len(names))) for after in ",|;\n"]
        self._forget()

    def _forget(self) -> None:
        """Empties the kept segments: the row of each, and by row counts, group text, whether it has tokens, and the place of its links."""
        self.kept: dict[str, int] = {}
        self.counts, self.texts, self.fine = np.zeros((0, 4), np.int64), [], np.zeros(0, bool)
        self.links = np.zeros(0, np.int64)

    def _facts(self, segments: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Counts, group text and whether the tokens' bytes are its own for each segment, and the linked id pairs of all, in order.

        Segments are worked on together, their tokens one after the other in flat arrays; ends are places in
        the bytes of all.
        """
        spaced = [" " + s for s in segments]
        raw = [s.encode("utf-8") for s in spaced]
        raw_sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.concatenate([[0], np.cumsum(raw_sizes)])
        whole = b"".join(raw)
        coded_a = self.a.encode_batch(spaced, add_special_tokens=False)
        coded_b = self.b.encode(segments, return_type="offset_mapping", num_threads=1)
        sides, good = [], np.ones(len(raw), bool)
        for ids, spans, table, lengths, shift in (
            ([e.ids for e in coded_a], [e.offsets for e in coded_a], self.a_bytes, self.a_lengths, 0),
            ([e["ids"] for e in coded_b], [e["offsets"] for e in coded_b], self.b_bytes, self.b_lengths, 1),
        ):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            listed = list(chain.from_iterable(ids))
            flat = np.array(listed, np.int64)
            of = np.repeat(np.arange(len(ids)), sizes)
            decoded = np.cumsum(lengths[flat])
            # if every segment has as many bytes as its own, the joined bytes compare them all
            if not ((np.bincount(of, weights=lengths[flat], minlength=len(raw)) == raw_sizes).all() and b"".join(map(table.__getitem__, listed)) == whole):
                good &= [b"".join(map(table.__getitem__, i)) == r for i, r in zip(ids, raw)]
            span_ends = np.array([e for own in spans for _, e in own], np.int64) + shift
            sides.append((sizes, flat, of, span_ends, decoded))
        if not good.all():
            counts, texts = np.zeros((len(segments), 4), np.int64), [""] * len(segments)
            links = np.zeros(0, np.int64)
            if good.any():
                counts[good], found, links, _ = self._facts([s for s, fine in zip(segments, good.tolist()) if fine])
                for k, text in zip(np.flatnonzero(good).tolist(), found):
                    texts[k] = text
            return counts, texts, links, good
        in_bytes = np.zeros(len(segments), bool)
        in_bytes[sides[1][2][self.b_single[sides[1][1]]]] = True
        plain = ~in_bytes & (raw_sizes == np.fromiter(map(len, spaced), np.int64, len(raw)))
        # the spans are the coarse cuts; multibyte characters and byte tokens are refined by decoded bytes
        ends = [np.where(plain[of], starts[of] + spans, decoded) for _, _, of, spans, decoded in sides]
        group_of = []
        for k in (0, 1):
            cut = np.isin(ends[k], ends[1 - k])
            group_of.append(np.concatenate([[0], np.cumsum(cut)[:-1]]))
        (sizes_a, ids_a, seg_a, *_), (sizes_b, ids_b, seg_b, *_) = sides
        groups = int(group_of[0][-1]) + 1
        n_a, n_b = (np.bincount(g, minlength=groups) for g in group_of)
        # every A token with every B token of its group
        many = n_b[group_of[0]]
        first = (np.cumsum(n_b) - n_b)[group_of[0]]
        links = np.repeat(ids_a, many) * self.width + ids_b[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        links_of = np.bincount(seg_a, weights=many, minlength=len(segments)).astype(np.int64)
        groups_of = np.bincount(seg_a[np.cumsum(n_a) - 1], minlength=len(segments))
        # the text, by group and A before B: each id with what follows it
        side = np.concatenate([np.zeros(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)])
        order = np.argsort(np.concatenate(group_of) * 2 + side, kind="stable")
        group, side, of = np.concatenate(group_of)[order], side[order], np.concatenate([seg_a, seg_b])[order]
        after = np.full(len(order), 0)  # a comma
        after[:-1] = np.where(of[1:] != of[:-1], 3, np.where(group[1:] != group[:-1], 2, side[1:] - side[:-1]))
        after[-1] = 3
        spelled = (4 * np.concatenate([ids_a, ids_b])[order] + after).tolist()
        texts = "".join(map(self.spelled.__getitem__, spelled)).split("\n")[:-1]
        return np.column_stack([sizes_a, sizes_b, groups_of, links_of]), texts, links, good

    def _add(self, missing: list[str]) -> None:
        """Adds segments that are not kept yet."""
        held, chunk, made = 0, [], []
        self.kept.update(zip(missing, range(len(self.texts), len(self.texts) + len(missing))))
        for k, segment in enumerate(missing):
            chunk.append(segment)
            held += len(segment)
            if len(chunk) < workers.ENCODED_AT_ONCE and held < SEGMENT_CHARS and k < len(missing) - 1:
                continue
            made.append(self._facts(chunk))
            held, chunk = 0, []
        if made:
            counts, texts, links, fine = zip(*made)
            self.counts, self.links, self.fine = (np.concatenate([old, *new]) for old, new in ((self.counts, counts), (self.links, links), (self.fine, fine)))
            self.texts.extend(chain.from_iterable(texts))

    def aligned(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts: counts, group text and number of distinct linked pairs of each, and the pairs of all, in order, with their times."""
        cut = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        missing = set(chain.from_iterable(cut)).difference(self.kept)
        # long segments come last, to be let go after these texts
        long = [s for s in missing if len(s) > LONGEST_KEPT]
        missing = [s for s in missing if len(s) <= LONGEST_KEPT]
        kept_rows = len(self.texts) + len(missing)
        self._add(missing + long)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        own = list(map(self.kept.__getitem__, chain.from_iterable(cut)))
        rows, of = np.array(own, np.int64), np.repeat(np.arange(len(cut)), sizes)
        bad = np.zeros(len(cut), bool)
        bad[of[~self.fine[rows]]] = True
        use = ~bad[of]
        counts = np.zeros((len(cut), 4), np.int64)
        for k in range(4):
            counts[:, k] = np.bincount(of[use], weights=self.counts[rows[use], k], minlength=len(cut))
        ends = np.cumsum(sizes).tolist()
        groups = ["" if none else ";".join(map(self.texts.__getitem__, own[end - n : end])) for none, n, end in zip(bad.tolist(), sizes.tolist(), ends)]
        # links of all the texts' segments; a text's pairs are counted by its place and the pair in one number
        firsts = np.cumsum(self.counts[:, 3]) - self.counts[:, 3]
        many = self.counts[rows[use], 3]
        links = self.links[np.repeat(firsts[rows[use]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        span = len(self.a_lengths) * self.width
        pairs, times = np.unique(np.repeat(of[use], many) * span + links, return_counts=True)
        distinct = np.bincount(pairs // span, minlength=len(cut))
        if kept_rows > CACHE_ROWS:
            self._forget()
        elif long:
            for s in long:
                del self.kept[s]
            self.links = self.links[: self.counts[:kept_rows, 3].sum()].copy()
            self.counts, self.fine = self.counts[:kept_rows].copy(), self.fine[:kept_rows].copy()
            del self.texts[kept_rows:]
        return counts, groups, distinct, pairs % span, times

    def align(self, texts: list[str | None]) -> list[tuple | None]:
        """(counts, group text, pairs, times) of each text; None without tokens."""
        counts, groups, distinct, pairs, times = self.aligned(texts)
        ends = np.cumsum(distinct)[:-1]
        rows = zip(counts.tolist(), groups, np.split(pairs, ends), np.split(times, ends))
        return [row if row[0][0] else None for row in rows]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every row's alignment: doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    A reads a space and the text, B the text, to which it adds the space itself; strings of special
    tokens are plain text. ``groups`` lists the groups as ``a1,a2|b1;a3|b2,b3``. A link is a pair of
    token occurrences, one of each tokenizer, in one group; ``pairs`` are the distinct linked id
    pairs, A's id times B's vocabulary size plus B's id, and ``times`` their links. A text that is
    null, empty, or that either tokenizer does not give back byte for byte has no tokens: zeros,
    no groups. Repeated rows stay repeated, a null doc_id stays null, an empty table gives an empty result,
    further columns are ignored. The files must be in every worker's reach.
    """
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for batch in batches:
            texts, start, held = batch.column("text"), 0, 0
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1].as_py() or "")
                if held < BATCH_CHARS and end < len(texts):
                    continue
                found, groups, distinct, pairs, times = tool.aligned(texts[start:end].to_pylist())
                columns = [pa.array(found[:, k].copy(), pa.int64()) for k in range(4)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(distinct)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64())) for values in (pairs, times)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[start:end], *columns, pa.array(groups, pa.string()), *lists],
                    ["doc_id", *counts, "groups", "pairs", "times"],
                )
                start, held = end, 0

    rest = StructType.fromDDL(", ".join(f"{c} long" for c in counts) + ", groups string, pairs array<long>, times array<long>")
    schema = StructType([docs.schema["doc_id"], *rest.fields])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, held, best): in how many documents a pair is linked, and whether that is the most of its A id."""
    held = materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held")))
    first = F.floor(F.col("pair") / F.lit(width)).alias("first")
    most = held.groupBy(first).agg(F.max("held").alias("most"))
    return held.withColumn("first", first).join(most, "first").select("pair", "held", (F.col("held") == F.col("most")).alias("best"))


def _head(counts: DataFrame, rows: int) -> tuple[pa.Table, int]:
    """The pairs that at least so many documents hold, as few documents as ``rows`` pairs allow."""
    least, taken = 0, 0
    for held, n in sorted(((r["held"], r["n"]) for r in counts.groupBy("held").agg(F.count("*").alias("n")).collect()), reverse=True):
        if taken + n > rows:
            least = held + 1
            break
        taken += n
    return counts.where(F.col("held") >= least).toArrow(), least


def link_scores(aligned: DataFrame, width: int, head_rows: int = HEAD_ROWS) -> DataFrame:
    """The rows of ``aligned`` with n_best and count_sum in place of pairs and times.

    A link's count is the number of rows of ``aligned`` that hold its id pair linked: count_sum is
    their sum over the row's links, n_best the number of links whose count is the highest that a pair with the same
    A id has anywhere, ties included. ``width`` is the size of B's vocabulary. ``aligned`` is read
    twice; write it first.
    """
    counts = materialize(pair_counts(aligned, width))
    head, least = _head(counts, head_rows)
    order = np.argsort(head.column("pair").to_numpy())
    table = tuple(head.column(c).to_numpy()[order] for c in ("pair", "held", "best"))
    shared = aligned.sparkSession.sparkContext.broadcast(table)
    carried = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, best = shared.value
        for batch in batches:
            sums, bests, left, left_times = [], [], [], []
            for own, times in zip(batch.column("_pairs"), batch.column("_times")):
                own, times = own.values.to_numpy(), times.values.to_numpy()
                place = np.searchsorted(pairs, own)
                known = place < len(pairs)
                known[known] = pairs[place[known]] == own[known]
                sums.append(int((held[place[known]] * times[known]).sum()))
                bests.append(int(times[known][best[place[known]]].sum()))
                left.append(own[~known])
                left_times.append(times[~known])
            kind = pa.list_(pa.int64())
            columns = [pa.array(sums, pa.int64()), pa.array(bests, pa.int64()), pa.array(left, kind), pa.array(left_times, kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_own{k}") for k in range(len(carried))), *columns], schema.names)

    more = StructType.fromDDL("_sum long, _best long, _left array<long>, _left_times array<long>")
    renamed = aligned.select(*(F.col(c).alias(f"_own{k}") for k, c in enumerate(carried)), F.col("pairs").alias("_pairs"), F.col("times").alias("_times"))
    schema = StructType([*renamed.schema.fields[: len(carried)], *more.fields])
    if not least:
        rows = renamed.mapInArrow(run, schema)
    else:
        found = materialize(renamed.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))
        links = found.select("_row", F.explode(F.arrays_zip("_left", "_left_times")).alias("l"))
        links = links.select("_row", F.col("l._left").alias("pair"), F.col("l._left_times").alias("t"))
        rare = links.join(counts.where(F.col("held") < least), "pair").groupBy("_row")
        added = rare.agg(F.sum(F.col("held") * F.col("t")).alias("_more"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_more_best"))
        rows = found.join(added, "_row", "left")
        rows = rows.withColumns({"_sum": F.col("_sum") + F.coalesce("_more", F.lit(0)), "_best": F.col("_best") + F.coalesce("_more_best", F.lit(0))})
    return rows.select(*(F.col(f"_own{k}").alias(c) for k, c in enumerate(carried)), F.col("_best").alias("n_best"), F.col("_sum").alias("count_sum"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every row's counts, groups_sha256 (hex; empty without tokens), n_best and count_sum; see ``align`` and ``link_scores``."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    path = scratch_path(docs.sparkSession, "aligned")
    align(docs, a_path, b_path).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times").write.parquet(path)
    width = workers.pieces(b_path).vocab_size()
    return link_scores(docs.sparkSession.read.parquet(path), width)
