"""Token counts by a two-tier lookup on the map side.

A text's tokens are those of its pre-tokens, and most pre-tokens are few and frequent. The first tier is a
table of frequent pre-tokens and their numbers of tokens, broadcast to all workers; it is filled from a
bounded sample of documents, which decides how often it answers and never what. What it lacks is
encoded by the tokenizer itself, a batch at a time, and kept in a bounded cache of the worker. No pre-token is shuffled.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from sitegauge.llm import workers

#: Documents that fill the table, its entries, and a worker's cache entries.
SAMPLE_DOCS = 4_000
TABLE_ROWS = 1 << 16
#: Entries of the sample that one task hands to the driver; no pre-token is shuffled there either.
TASK_ROWS = 1 << 14
CACHE_ROWS = 200_000
#: Longer pre-tokens are not kept from one batch to the next.
LONGEST_KEPT = 64
#: Characters of texts that are looked up together.
BATCH_CHARS = 1 << 20

# Fixed value: how byte-level BPE of this kind cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TwoTiers:
    """Counts tokens of texts: the broadcast table, then the cache, then the process's tokenizer."""

    def __init__(self, path: str, table: dict[str, int] | None = None) -> None:
        self.tokenizer = workers.byte_level(path)
        self.cut = regex.compile(PATTERN).findall
        self.table = table or {}
        self.cache: dict[str, int] = {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))).search if special else lambda text: None

    def sizes(self, parts: list[str]) -> list[int]:
        """Numbers of tokens of pre-tokens, a bounded number of them encoded at once."""
        found: list[int] = []
        for start in range(0, len(parts), workers.ENCODED_AT_ONCE):
            coded = self.tokenizer.encode_batch(parts[start : start + workers.ENCODED_AT_ONCE], add_special_tokens=False)
            found += [len(e.ids) for e in coded]
        return found

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, texts: list[str]) -> list[int]:
        """A text that holds a special token's string goes to the tokenizer whole, to be read its way."""
        cuts = [None if self.special(t) else self.cut(t) for t in texts]
        table, cache = self.table, self.cache
        missing = [p for p in set(chain.from_iterable(c for c in cuts if c)) if p not in table and p not in cache]
        found = dict(zip(missing, self.sizes(missing))) if missing else {}
        cache.update(found)
        counts = []
        for text, cut in zip(texts, cuts):
            if cut is None:
                counts.append(self.whole(text))
            else:
                counts.append(sum(n if (n := table.get(p)) is not None else cache[p] for p in cut))
        for part in found:
            if len(part) > LONGEST_KEPT:
                del cache[part]
        if len(cache) > CACHE_ROWS:
            cache.clear()
        return counts


def frequent_pretokens(docs: DataFrame, path: str, total: int | None = None) -> dict[str, int]:
    """The first tier: the most frequent pre-tokens of a bounded, hash-picked sample, with their sizes."""
    total = docs.count() if total is None else total
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    text = F.col("text").cast("string").alias("text")
    picked = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20))).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = regex.compile(PATTERN).findall, Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(p for p in cut(text.as_py() or "") if len(p) <= LONGEST_KEPT)
        kept = counts.most_common(TASK_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["p", "n"])

    rows = picked.mapInArrow(run, "p string, n long").limit(16 * TABLE_ROWS).toArrow()
    counts: Counter = Counter()
    for part, n in zip(rows.column("p").to_pylist(), rows.column("n").to_pylist()):
        counts[part] += n
    parts = [p for p, n in counts.most_common(TABLE_ROWS) if n > 1]
    return dict(zip(parts, TwoTiers(path).sizes(parts)))


#: The counter of this worker process and the name of its broadcast table.
_counter: dict[str, tuple[str, TwoTiers]] = {}


def _of_process(path: str, name: str, shared: Broadcast) -> TwoTiers:
    """One counter a process, kept from task to task while the broadcast table, known by ``name``, is the same."""
    held = _counter.get(path)
    if held is None or held[0] != name:
        _counter[path] = (name, TwoTiers(path, shared.value))
    return _counter[path][1]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row, as the tokenizer file at ``path`` gives them.

    ``path`` names a byte-level BPE file that every worker has, such as one in an installed package.
    A null text counts as empty: no bytes, no tokens. Repeated rows stay repeated, a null doc_id
    stays null, an empty table gives an empty result, further columns are ignored.
    """
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _of_process(path, name, shared)
        for batch in batches:
            sizes, counts, group, held = [], [], [], 0
            for value in batch.column("text"):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                group.append(text)
                held += len(text)
                if held >= BATCH_CHARS:
                    counts += counter.count(group)
                    group, held = [], 0
            counts += counter.count(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    schema = StructType([docs.schema["doc_id"]]).add("n_bytes", LongType()).add("n_tokens", LongType())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
