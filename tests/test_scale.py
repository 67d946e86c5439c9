"""Bounds of memory and work that hold for sites of any size."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sitegauge import session as S
from sitegauge.operators import blocks as B
from sitegauge.operators import pairs as P
from sitegauge.operators import ranks as G
from sitegauge.operators import termcounts as T
from sitegauge.operators import tfidf as D


def test_weights_count_terms_once(spark):
    texts = spark.createDataFrame([("s", "a", "red hat"), ("s", "b", "red coat")], "site_id string, url string, text string")
    plan = D.tfidf_weights(texts, D.CONTENT_ONLY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_weights_of_a_site_in_slices(spark, monkeypatch):
    rows = [("s", f"p{i}", f"red hat w{i % 3}") for i in range(9)] + [("s", "p0", "red coat"), ("t", "q", "red hat")]
    texts = spark.createDataFrame(rows, "site_id string, url string, text string")
    whole = {tuple(r) for r in D.tfidf_weights(texts, D.URL_ONLY).collect()}
    monkeypatch.setattr(D, "PAGES_PER_SLICE", 4)
    assert {tuple(r) for r in D.tfidf_weights(texts, D.URL_ONLY).collect()} == whole


def test_weights_of_a_site_in_slices_make_terms_once(spark, monkeypatch):
    monkeypatch.setattr(D, "PAGES_PER_SLICE", 4)
    rows = [("s", f"p{i}", f"red w{i}") for i in range(9)]
    weights = D.tfidf_weights(spark.createDataFrame(rows, "site_id string, url string, text string"), D.URL_ONLY)
    # the sum over slices reads the counted rows, not the texts again
    assert "regexp_extract_all" not in weights._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.term, r.df) for r in weights.collect()} == {(f"w{i}", 1) for i in range(9)} | {(f"red w{i}", 1) for i in range(9)}


def test_terms_of_many_pages_stay_where_they_are(spark, monkeypatch):
    """Pages whose terms are many give the same rows, and no shuffle deals out terms: blocks ask for their page counts."""
    rows = [("s", f"p{i}", f"red hat w{i % 3} x{i}") for i in range(30)] + [("s", "p0", "red coat"), ("s", None, "blue hat"), ("s", None, "hat"), ("s", "none", None)]
    rows += [("t", "q", "red hat"), (None, "r", "red hat"), ("u", "a", "same same"), ("u", "b", "same other")]
    texts = spark.createDataFrame(rows, "site_id string, url string, text string")
    weights, vectors = (f(texts, D.CONTENT_ONLY).collect() for f in (D.tfidf_weights, D.term_vectors))
    monkeypatch.setattr(D, "MOVED_PAGES", 0)
    monkeypatch.setattr(T, "BLOCK_TERMS", 25)
    found = D.term_vectors(texts, D.CONTENT_ONLY)
    keys = re.findall(r"Exchange hashpartitioning\((\w+?)(?:#\d+\w*)?[,)]", found._jdf.queryExecution().executedPlan().toString())
    assert set(keys) == {"block", "part"}
    assert sorted(map(str, found.collect())) == sorted(map(str, vectors))
    assert sorted(map(str, D.tfidf_weights(texts, D.CONTENT_ONLY).collect())) == sorted(map(str, weights))
    # numbers are one to one with terms
    named = {(r.site_id, r.url): sorted((t.df, t.w) for t in r.terms) for r in vectors}
    numbered = D.term_vectors(texts, D.CONTENT_ONLY, numbers=True).collect()
    assert {(r.site_id, r.url): sorted((t.df, t.w) for t in r.terms) for r in numbered} == named
    assert len({t.term for r in numbered for t in r.terms}) == len({(r.site_id, t.term) for r in vectors for t in r.terms})


def test_tiles_are_bounded_and_meet_every_pair_once(monkeypatch):
    monkeypatch.setattr(B, "TILE_ROWS", 4)
    monkeypatch.setattr(B, "TILE_VALUES", 12)
    for group, corner in ((np.zeros(11, int), (0, 0)), (np.arange(11) % 2, (0, 1))):
        table = pa.table({"grp": group, "ci": [corner[0]] * 11, "cj": [corner[1]] * 11})
        met = []
        for rows, columns, distance, mask in B.tiles(table, np.arange(22.0).reshape(11, 2), B.euclidean):
            assert distance.size <= 12
            met += [(rows[i], columns[j]) for i, j in zip(*np.nonzero(np.ones_like(distance, bool) if mask is None else mask))]
        wanted = {frozenset((i, j)) for i in range(11) for j in range(i) if corner == (0, 0) or group[i] != group[j]}
        assert len(met) == len(wanted) and {frozenset(p) for p in met} == wanted


def test_nearest_kernel_holds_bounded_tiles(monkeypatch):
    monkeypatch.setattr(B, "TILE_VALUES", 40)
    sizes, measure = [], B.cosine
    monkeypatch.setattr(B, "cosine", lambda a, b: sizes.append(len(a) * len(b)) or measure(a, b))
    x = np.random.default_rng(1).normal(size=(20, 3))
    names = [f"p{i:02d}" for i in range(20)]
    columns = {"site_id": ["s"] * 20, "rep": names, "urls": [[n] for n in names], "embedding": x.tolist(), "grp": [0] * 20, "ci": [0] * 20, "cj": [0] * 20}
    found = P._nearest_kernel(3)(pa.table(columns))
    assert max(sizes) <= 40 and len(found) == 60


def test_pruned_sites_are_not_copied_to_small_cells(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(P, "_cell_max", lambda rows, by, d, metric, size, run=P._cell_max: seen.append(size) or run(rows, by, d, metric, size))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    frame = spark.createDataFrame([("s", f"p{i}", v.tolist()) for i, v in enumerate(x)], "site_id string, url string, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert abs(P.diameter_cosine(frame, 4, group_rows=7).first().diameter - (1 - unit @ unit.T).max()) < 1e-9
    assert seen == [B.rows_per_group(4)]


def test_top_pairs_rank_few_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [("s", f"a{i:03d}", f"b{i:03d}", float(d)) for i, d in enumerate(np.round(rng.normal(size=400), 2))]
    rows += [("s", "n", f"n{i}", None) for i in range(3)] + [("t", "a", "b", 0.0), ("t", "c", "d", -1.0), ("t", "e", "f", float("nan"))]
    pairs = spark.createDataFrame(rows, "site_id string, url1 string, url2 string, distance double")
    for descending in (False, True):
        for limit in (2, 5, 50, 1000):
            lead = F.desc("distance") if descending else F.asc("distance")
            best = G._top(pairs, [lead, F.asc("url1"), F.asc("url2")], limit).select("site_id", "rank", "url1", "url2")
            got = G.top_pairs(pairs, limit, "distance", descending)
            assert sorted(map(tuple, got.select("site_id", "rank", "url1", "url2").collect())) == sorted(map(tuple, best.collect()))
            assert {(r.site_id, r.total_pairs) for r in got.collect()} == {("s", 403), ("t", 3)}


def test_near_duplicates_shuffle_no_pairs(spark):
    points = spark.createDataFrame(
        [("s", f"p{i}", float(i % 3) / 4, 0.0) for i in range(30)] + [("s", None, 0.1, 0.0)], "site_id string, url string, x double, y double"
    )
    found = P.near_duplicates(points, 1.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") > plan.index("Generate explode(pages2")
    # 300 pairs of different places, and the page without a name beside each of the others
    assert found.count() == 330 and found.where("url1 = url2").count() == 30


def test_term_rows_are_not_checkpointed_whole(spark):
    rows = [("s", f"p{i}", " ".join(f"w{(i * j) % 97}" for j in range(30))) for i in range(40)]
    vectors = D.term_vectors(spark.createDataFrame(rows, "site_id string, url string, text string"), D.URL_ONLY)
    S.materialize(spark.range(1))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.iterdir())
    P.similar_term_pairs(vectors, 0.5).collect()
    assert set(folder.iterdir()) == before
