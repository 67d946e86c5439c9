"""The parity-sketch join against brute force over all pairs of documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import parity
from sitegauge.llm.components import components


def shingles(text, width=5):
    for gap in "\t\n\x0b\f\r":
        text = (text or "").replace(gap, " ")
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted(((-1 if doc is None else doc), len(s), least.get(g, -1)) for (doc, _), s, g in zip(rows, sets, group))


def corpus(seed, passages=3):
    """Texts with copies at about 0.6 to 1.0, chains, shared passages, and odd rows."""
    rng = random.Random(seed)
    shared = [[f"p{k}{j}" for j in range(60)] for k in range(passages)]
    rows = []
    for doc in range(30):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 12, 30, 130, 140, 300, 900]))]
        if passages and rng.random() < 0.7:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        rows.append((10_000 + 200 * doc, " ".join(words)))
        for k in range(rng.choice([0, 1, 3]) if doc else 40):
            copy = list(words if rng.random() < 0.6 else rows[-1][1].split())
            for _ in range(round(len(copy) * rng.uniform(0, 0.06))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [f"c{rng.randrange(10**6)}"] * rng.choice([0, 1])
            rows.append((10_000 + 200 * doc - k - 1, "\n".join(copy).upper()))
    odd = [(1, None), (2, " "), (3, ""), (4, "Two Words"), (5, "two  words"), (6, "Été Жук"), (7, "été Жук"), (7, "été Жук"), (None, "two words"), (None, "alone here"), (8, "x " * 40_000)]
    return rows + odd


@pytest.mark.parametrize(("seed", "crowd"), [(2, 3), (3, 0)])
def test_matches_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(parity, "CROWD", crowd)
    monkeypatch.setattr(parity, "CROWD_BLOCK", 16)
    monkeypatch.setattr(parity, "SHARE_SHINGLES", 500)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("clash"), "n": F.lit(0), "node": F.lit(1)})
    out = parity.near_duplicates(docs)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out.collect())
    assert got == brute(rows)


def test_texts_that_are_mostly_one_passage(spark, monkeypatch):
    """All keys are crowded: documents of one passage and little else, in several components."""
    monkeypatch.setattr(parity, "CROWD", 8)
    monkeypatch.setattr(parity, "CROWD_BLOCK", 16)
    rng = random.Random(4)
    passage = [f"p{j}" for j in range(60)]
    rows = []
    for doc in range(90):
        own = [f"{doc // 3}x{j}" for j in range(rng.choice([0, 4, 9, 14, 30]))]
        rows.append((doc, " ".join(passage + own)))
    out = parity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute(rows)


def test_linked_sets_share_a_key():
    """Also at the least similarity, at every size, and whatever is thought frequent."""
    rng = np.random.default_rng(4)
    for size in [5, 6, 9, 10, 17, 31, 32, 33, 80, 127, 128, 500] * 15:
        every = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        lost = size // 5
        cut = rng.integers(0, lost + 1)
        one, other = np.sort(rng.permutation(every)[cut:]), None
        rest = np.setdiff1d(every, one)
        other = np.sort(np.concatenate([rest, rng.permutation(one)[: size - lost + cut - len(rest)]]))
        met, all_ = len(np.intersect1d(one, other)), len(np.union1d(one, other))
        if 100 * met < 80 * all_ or met == all_:
            continue
        frequent = np.sort(rng.choice(every, len(every) // 2, replace=False))
        seen = (frequent, rng.integers(3, 99, len(frequent)))
        keys = [{(b, k) for b, apart in parity.bands_of(len(s)) for k in parity.blocks([s], [b], [apart], seen)[0][0].tolist()} for s in (one, other)]
        assert keys[0] & keys[1]


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(100):
        one, other = (np.unique(rng.integers(0, 300, 100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        marks = [parity.blocks([s], [64], [5], none)[0][1] for s in (one, other)]
        assert np.bitwise_count(marks[0] ^ marks[1]).sum() <= len(np.setxor1d(one, other))


def test_sets_are_cut_into_blocks_alike_alone_and_together():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (5, 40, 6, 700)]
    frequent = (np.sort(np.concatenate([s[::3] for s in sets])), np.arange(3, 3 + sum(len(s[::3]) for s in sets)))
    bands, aparts = zip(*(parity.bands_of(len(s))[0] for s in sets))
    for k, (keys, folded) in enumerate(parity.blocks(sets, list(bands), list(aparts), frequent)):
        alone = parity.blocks([sets[k]], [bands[k]], [aparts[k]], frequent)[0]
        assert (keys == alone[0]).all() and (folded == alone[1]).all()


def test_empty_table(spark):
    assert parity.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rounds_let_go_of_what_is_over(spark):
    """Each round of the component search has the driver's garbage collected, so scratch of earlier rounds is dropped."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = old.getCollectionCount()
    links = spark.createDataFrame([(k, k + 1) for k in range(20)], "u long, v long")
    assert {r["root"] for r in components(links).collect()} == {0}
    assert old.getCollectionCount() >= before + 3
