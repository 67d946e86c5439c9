import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sitegauge.llm import components as components_module
from sitegauge.llm import simhash
from sitegauge.llm.components import components


def brute_fingerprint(text, width=3):
    gaps = " \t\n\x0b\f\r"
    for g in gaps[1:]:
        text = (text or "").replace(g, " ")
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    marks = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return [(doc, m, least.get(g)) for (doc, _), m, g in zip(rows, marks, group)]


def corpus():
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(300)] + ["Été", "ЖУК", " x"]
    rows = []
    for doc in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 200]))]
        rows.append((doc, " ".join(words)))
        for k in range(rng.choice([0, 0, 2])):
            words[rng.randrange(len(words))] = "changed%d" % k
            rows.append((1000 + 10 * doc + k, "\n".join(words)))
    rows += [(7000, None), (7001, ""), (7002, " \t\n"), (7003, rows[0][1]), (7003, rows[0][1]), (None, rows[0][1]), (None, "alone here"), (None, "alone here")]
    rows.append((7004, " ".join(rng.choice(vocabulary) for _ in range(30000))))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    found = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(found, key=key) == sorted(brute_components(rows), key=key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted({c for _, _, c in brute_components(rows) if c is not None})
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 1


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 3000)
    flips = [base ^ np.bitwise_or.reduce([np.int64(1) << rng.integers(0, 63, 3000) for _ in range(k)]) for k in (1, 2, 3)]
    dense = base[0] ^ (np.int64(1) << rng.integers(0, 63, 1500)) ^ (np.int64(1) << rng.integers(0, 63, 1500))
    fps = np.unique(np.concatenate([base, *flips, dense]))
    simhash_rows, simhash.SHARD_ROWS = simhash.SHARD_ROWS, 700
    try:
        trees = [simhash.grow_tree(fps[:: 3], len(fps), side, 1) for side in (0, 1)]
    finally:
        simhash.SHARD_ROWS = simhash_rows
    assert all(trees)
    group = {int(f): int(f) for f in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    copies = 0
    for side, nodes in enumerate(trees):
        for _, rows in simhash._route(nodes, fps, side, 1):
            copies += len(rows)
            for u, v in simhash.shard_links(fps[rows], side, 3):
                assert len(u) == 0 or np.bitwise_count(u ^ v).max() <= 64
                for a, b in zip(u.tolist(), v.tolist()):
                    group[find(a)] = find(b)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for i, j in zip(*np.nonzero(near)):
        assert find(int(fps[i])) == find(int(fps[j]))
    for i, root in enumerate({find(int(f)) for f in fps}):  # nothing is linked that brute force keeps apart
        members = [k for k, f in enumerate(fps) if find(int(f)) == root]
        seen, front = {members[0]}, [members[0]]
        while front:
            front = [int(k) for f in front for k in np.flatnonzero(near[f]) if int(k) not in seen and not seen.add(int(k))]
        assert seen == set(members)
        if i > 40:
            break
    assert copies < 12 * len(fps)


def test_stars_take_no_rounds(spark, monkeypatch):
    from sitegauge.llm import components as C

    monkeypatch.setattr(C, "_large_star", lambda links: 1 / 0)
    links = spark.createDataFrame([(3, 1), (1, 2), (8, 7), (8, 7), (5, 5), (None, 4)], "u long, v long")
    assert {(r.node, r.root) for r in C.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert not C._are_stars(spark.createDataFrame([(3, 2), (2, 1)], "u long, v long"))
    assert not C._are_stars(spark.createDataFrame([(3, 2), (3, 1)], "u long, v long"))


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 1), (20, 21), (None, 4), (21, 20)]
    found = {(r.node, r.root) for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {(k, 1) for k in (1, 2, 3, 7, 8, 9)} | {(20, 20), (21, 20)}
    chain = spark.range(300).selectExpr("id u", "id + 1 v")
    assert {r.root for r in components(chain).collect()} == {0}


def test_components_with_hubs(spark, monkeypatch):
    rng = random.Random(3)
    links = [(7, k) for k in range(1000, 1600)] + [(k, 5) for k in range(1300, 1700)] + [(2, 9000), (9000, 1650)]
    links += [(20000 + k, 20000 + rng.randrange(k)) for k in range(1, 400)] + [(30000, 40000 + k) for k in range(300)]
    table = spark.createDataFrame(links, "u long, v long")
    want = {k: 2 for a, b in links for k in (a, b) if k < 20000}
    want |= {k: 30000 for k in [30000, *range(40000, 40300)]} | {20000 + k: 20000 for k in range(400)}
    assert {r.node: r.root for r in components(table).collect()} == want
    monkeypatch.setattr(components_module, "counted_small", lambda df: False)
    assert {r.node: r.root for r in components(table).collect()} == want


def test_reduced_links_keep_components():
    rng = np.random.default_rng(9)
    u, v = rng.integers(-400, 400, (2, 500))
    nodes, roots = simhash.reduced(u, v)
    least = {int(k): int(k) for k in np.concatenate([u, v])}
    for _ in range(len(least)):
        before = dict(least)
        for a, b in zip(u.tolist(), v.tolist()):
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert dict(zip(nodes.tolist(), roots.tolist())) == {k: r for k, r in least.items() if k != r}
    assert all(len(part) == 0 for part in simhash.reduced(u[:0], v[:0]))


def test_crowded_leaf_is_cut_and_loses_no_pair(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 200)
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**20, 900) << np.int64(32))  # one low half for all: no split by it
    nodes = simhash.grow_tree(fps[::4], len(fps), 0, 1)
    assert [n[1] < 0 for n in nodes] == [True]
    shards = [set(rows.tolist()) for _, rows in simhash._route(nodes, fps, 0, 1)]
    assert max(map(len, shards)) < 300
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert all(any({i, j} <= s for s in shards) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))))


def test_links_across_the_sign_bit():
    """Fingerprints whose difference includes the highest bit are signed numbers far apart."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    flips = np.array([1 << 63, (1 << 63) + 1, (1 << 63) + 6, 7], dtype=np.uint64).view(np.int64)
    for flip in flips:
        u, v = simhash._stars(np.concatenate([base, base ^ flip]), 3)
        assert {frozenset(p) for p in zip(u.tolist(), v.tolist())} == {frozenset((int(b), int(b ^ flip))) for b in base}
    for side in (0, 1):
        u, v = simhash._stars(np.array([5, ~5], dtype=np.int64), 3)
        assert not len(u)


def test_keep_one_judges_each_text_of_an_id(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(5, long, 1), (5, "quite another text", 2), (9, long, 3), (None, long, 4), (None, "nameless", 5), (None, "nameless", 5), (5, long, 1), (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    kept = {tuple(r) for r in simhash.keep_one(docs).collect()}
    assert kept == {(5, long, 1), (5, "quite another text", 2), (None, "nameless", 5), (7, None, 6)}
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs.where("false")).count() == 0
