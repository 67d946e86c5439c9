"""Nearest pages and components of sparse rows, and layouts, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import pairs as P
from sitegauge.operators import sparse as SP
from sitegauge.operators import tfidf as D
from sitegauge.operators import topicmap as M
from sitegauge.plans import analysis as A


def term_rows(spark, seed=1, pages=70):
    """Two sites and a lone page: topics, copies, a page without terms, words that most pages have."""
    rng = np.random.default_rng(seed)
    rows = []
    for site, count in (("big", pages), ("small", 9)):
        for i in range(count):
            topic = rng.integers(4)
            words = [f"t{topic}w{rng.integers(30)}" for _ in range(rng.integers(3, 25))] + [f"c{rng.integers(6)}" for _ in range(6)]
            rows.append((site, f"{site}{i:03d}", " ".join(words)))
    rows += [("big", f"copy{i}", rows[3][2]) for i in range(20)] + [("big", "none", ""), ("one", "alone", "some words")]
    texts = spark.createDataFrame(rows, "site_id string, url string, text string")
    return D.term_vectors(texts, D.URL_ONLY)


def dense(vectors):
    rows = vectors.collect()
    names = sorted({t.term for r in rows for t in r.terms})
    place = {t: k for k, t in enumerate(names)}
    out = {}
    for r in rows:
        v = np.zeros(len(names))
        for t in r.terms:
            v[place[t.term]] = t.w
        out.setdefault(r.site_id, {})[r.url] = v
    return out


def brute_nearest(vectors, k):
    found = set()
    for site, rows in dense(vectors).items():
        for url, v in rows.items():
            near = sorted((round(1 - v @ w, 9), u) for u, w in rows.items() if u != url and v @ w > 0)
            found |= {(site, url, rank, u, round(d, 6)) for rank, (d, u) in enumerate(near[:k], 1)}
    return found


@pytest.mark.parametrize(("rare", "k", "cell"), [(64, 5, 1024), (4, 5, 16), (0, 3, 16), (8, 40, 1024)])
def test_nearest_by_terms(spark, monkeypatch, rare, k, cell):
    monkeypatch.setattr(SP, "CELL_PAGES", cell)
    monkeypatch.setattr(SP, "PRODUCTS", 50)
    monkeypatch.setattr(SP, "MATRIX_TERMS", 5)
    vectors = term_rows(spark).cache()
    got = {(r.site_id, r.url, r["rank"], r.neighbour, round(r.distance, 6)) for r in SP.nearest_by_terms(vectors, k, rare).collect()}
    assert got == brute_nearest(vectors, k)


def test_nearest_by_terms_in_rounds(spark, monkeypatch):
    """Parts meet a few at a time, tiles of parts one by one."""
    for name, value in (("CELL_PAGES", 12), ("TILE_PAGES", 5), ("ROUND_STEPS", 1)):
        monkeypatch.setattr(SP, name, value)
    vectors = term_rows(spark).cache()
    got = {(r.site_id, r.url, r["rank"], r.neighbour, round(r.distance, 6)) for r in SP.nearest_by_terms(vectors, 4, 4).collect()}
    assert got == brute_nearest(vectors, 4)


@pytest.mark.parametrize("share", [0.0, 1e9])
def test_similar_term_pairs_by_lists_and_whole(spark, monkeypatch, share):
    monkeypatch.setattr(P, "DENSE_SHARE", share)
    monkeypatch.setattr(SP, "CELL_PAGES", 16)
    monkeypatch.setattr(SP, "TILE_PAGES", 7)
    vectors = term_rows(spark).cache()
    for bound, limit in ((0.2, 40), (0.5, 1000)):
        want = []
        for site, rows in dense(vectors).items():
            near = sorted((-round(float(rows[a] @ rows[b]), 9), a, b) for a in rows for b in rows if a < b and rows[a] @ rows[b] > bound)
            want += [(site, k, a, b) for k, (_, a, b) in enumerate(near[:limit], 1)]
        got = P.similar_term_pairs(vectors, bound, limit, postings_per_sublist=4).collect()
        assert sorted((r.site_id, r["rank"], r.url1, r.url2) for r in got) == sorted(want)


def test_text_analysis_weighs_terms_once(spark, monkeypatch):
    """The layout reads its term rows many times: they are stored, not made of the texts each time."""
    seen = []

    def stop(vectors, **options):
        seen.append(vectors._jdf.queryExecution().optimizedPlan().toString())
        raise StopIteration

    monkeypatch.setattr(A, "term_map", stop)
    pages = spark.createDataFrame([("s", f"https://s/{i}", f"red hat w{i}") for i in range(4)], "site_id string, url string, processed_text string")
    with pytest.raises(StopIteration):
        A.text_analysis(pages, pages)
    assert "regexp" not in seen[0] and "Relation" in seen[0]


@pytest.mark.parametrize("every", [1, 3, 1000])
def test_parts_meet_once(spark, monkeypatch, every):
    """All pages, some or one of them ask; a page that does not ask goes to no cell of parts that do not."""
    monkeypatch.setattr(SP, "CELL_PAGES", 16)
    vectors = term_rows(spark).cache()
    rows = vectors.withColumns({"h1": F.xxhash64("terms"), "h2": F.xxhash64(F.lit(7), "terms")})
    groups = SP._in_url_order(SP.numbered(SP._copies(rows, 6))).cache()
    numbers = sorted((r.site_id, r.urls[0], r.page) for r in groups.collect())
    assert [n[2] for n in numbers] == sorted(n[2] for n in numbers)
    urls = {page: (site, url) for site, url, page in numbers}
    asking = groups.select("page").where(F.col("page").isin([page for _, _, page in numbers[::every]]))
    # a page's list over all cells holds its nearest of each part, each once
    found = SP._through_cells(asking, groups, 100).collect()
    assert len(found) == len({(r.page, r.other) for r in found})
    weights = dense(vectors)
    got = {(urls[r.page], urls[r.other], round(r.similarity, 9)) for r in found}
    want = {
        ((site, one), (site, other), round(float(weights[site][one] @ weights[site][other]), 9))
        for site, one, _ in numbers[::every]
        for s, other, _ in numbers
        if s == site and other != one and weights[site][one] @ weights[site][other] > 0
    }
    assert got == want


def test_pages_that_rare_terms_cannot_settle_form_no_pairs(spark):
    term = lambda name, df, w: (df, name, w)
    rows = [("s", f"u{i}", [term(f"rare{i // 2}", 2, 0.6), term("often", 99, 0.8)]) for i in range(6)]
    rows += [("s", f"v{i}", [term("own", 2, 1.0)]) for i in range(2)]
    vectors = spark.createDataFrame(rows, "site_id string, url string, terms array<struct<df: long, term: string, w: double>>")
    groups = SP.numbered(vectors.withColumn("page", F.monotonically_increasing_id()))
    rest = F.sqrt(SP._squares(F.filter("terms", lambda t: t["df"] > 64)))
    bounds = groups.select("site_id", "page", rest.alias("rest"), F.lit(0.8).alias("widest"))
    named = groups.select("page", "url").collect()
    urls = {r.page: r.url for r in named}
    # u: 0.36 known of one page, while the frequent term adds up to 0.64; v has no frequent term
    assert {(urls[r.page], urls[r.other]) for r in SP._known(groups, bounds, 64, 1).collect()} == {("v0", "v1"), ("v1", "v0")}


def test_cell_similarities():
    rng = np.random.default_rng(2)
    a, b = rng.random((40, 90)) * (rng.random((40, 90)) < rng.random(90)), rng.random((30, 90)) * (rng.random((30, 90)) < 0.1)
    sides = [(*np.nonzero(m), m[np.nonzero(m)]) for m in (a, b)]
    assert np.abs(SP.cell_similarities(*sides, 40, 30) - a @ b.T).max() < 1e-12


def test_products_of_terms_in_units(spark, monkeypatch):
    """Entries are dealt to units by term, and a page's products are summed over all of them."""
    monkeypatch.setattr(SP, "UNIT_ENTRIES", 300)
    monkeypatch.setattr(SP, "PACKED_ROWS", 16)
    monkeypatch.setattr(SP, "SHARE_BITS", 3)
    vectors = term_rows(spark).cache()
    rows = SP.numbered(vectors).withColumns({"page": F.monotonically_increasing_id(), "alone": SP._squares(F.filter("terms", lambda t: t["df"] <= 1))})
    rows = rows.withColumn("terms", F.filter("terms", lambda t: t["df"] > 1)).cache()
    units = SP._units(rows).cache()
    assert max(len(r.units) for r in units.collect()) > 3
    columns = 3
    q = rows.select("site_id", "url", "page", "alone", F.transform(F.array(*map(F.lit, range(columns))), lambda c: F.sin(F.col("page") * (c + 1.0))).alias("q")).cache()
    found = SP._times_covariance(SP._slabs(SP.attach_by_site(rows, units)), units, q, columns)
    got = {r.page: (r.site_id, list(r.q), np.array(r.y)) for r in found.collect()}
    given = {(r.site_id, r.url): (r.page, list(r.q)) for r in q.collect()}
    assert len(got) == found.count() == len(given)
    for site, pages in dense(vectors).items():
        a = np.array(list(pages.values()))
        values = np.array([given[site, url][1] for url in pages])
        for url, y in zip(pages, a @ (a.T @ values)):
            page, own = given[site, url]
            assert got[page][:2] == (site, own) and np.abs(got[page][2] - y).max() < 1e-12


def test_sparse_pca_spans_the_leading_axes(spark):
    vectors = term_rows(spark, pages=120).cache()
    got = {}
    for r in SP.sparse_pca(vectors, 4, power=6).collect():
        got.setdefault(r.site_id, {})[r.url] = r.coords
    for site, rows in dense(vectors).items():
        urls = sorted(rows)
        x = np.array([rows[u] for u in urls])
        u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        want, found = (u * s)[:, :4], np.array([got[site][u] for u in urls])
        assert np.abs(found.mean(axis=0)).max() < 1e-9
        size = min(4, want.shape[1])
        assert np.allclose(np.linalg.norm(found[:, :size], axis=0), s[:size], rtol=0.02, atol=1e-9)
        if len(urls) > 20:
            # the angle between the spaces of the first three axes, which a gap sets apart
            cosines = np.linalg.svd(np.linalg.qr(want[:, :3])[0].T @ np.linalg.qr(found[:, :3])[0])[1]
            assert cosines.min() > 0.99


@pytest.mark.parametrize("local_pages", [M.LOCAL_PAGES, 0])
def test_layout_ends_site_by_site(spark, local_pages):
    rng = np.random.default_rng(4)
    rows = [(f"s{n}", f"p{i:03d}", (rng.standard_normal(6) + 4 * (i % 3) * np.eye(6)[i % 3]).tolist()) for n in (2, 12, 90) for i in range(n)]
    vectors = spark.createDataFrame(rows, "site_id string, url string, embedding array<double>").cache()
    graph = M.neighbour_graph(P.nearest_pages(vectors, 6, 8)).cache()
    rounds = None if local_pages else 8
    found = M.layout(M.pca(vectors, 6, 2), graph, rounds=rounds, local_pages=local_pages).cache()
    assert {(r.site_id, r.url) for r in found.collect()} == {r[:2] for r in rows}
    ended = {r.site_id: r.rounds for r in found.groupBy("site_id").agg(F.max("rounds").alias("rounds"), F.min("rounds").alias("least")).where("rounds = least").collect()}
    assert len(ended) == 3
    kept = {r.site_id: r.kept for r in M.kept_neighbours(P.nearest_pages(vectors, 6, 8), found, 2, 8).collect()}
    assert kept["s90"] > 0.3 and kept["s2"] == 1.0
    if local_pages:
        assert all(n < 200 for n in ended.values()) and len(set(ended.values())) > 1
        alone = M.layout(M.pca(vectors, 6, 2).where("site_id = 's90'"), graph.where("site_id = 's90'"), local_pages=local_pages)
        whole = {r.url: list(r.coords) for r in found.where("site_id = 's90'").collect()}
        assert {r.url: list(r.coords) for r in alone.collect()} == whole


def test_kept_neighbours(spark):
    rows = [("s", f"p{i}", [float(i), 0.0]) for i in range(6)]
    coords = spark.createDataFrame(rows, "site_id string, url string, coords array<double>")
    nearest = spark.createDataFrame([("s", "p0", 1, "p1"), ("s", "p0", 2, "p5"), ("s", "p3", 1, "p2"), ("s", "p3", 2, "p4")], "site_id string, url string, rank int, neighbour string")
    assert [(r.site_id, r.pages, r.kept) for r in M.kept_neighbours(nearest, coords, 2, 2).collect()] == [("s", 2, 0.75)]


def test_layout_of_a_big_site_takes_few_jobs(spark):
    rng = np.random.default_rng(5)
    rows = [("s", f"p{i:03d}", (rng.standard_normal(6) + 4 * (i % 3) * np.eye(6)[i % 3]).tolist()) for i in range(90)]
    vectors = spark.createDataFrame(rows, "site_id string, url string, embedding array<double>").cache()
    near = P.nearest_pages(vectors, 6, 8).cache()
    start = M.pca(vectors, 6, 2).cache()
    # a page that no edge reaches is pushed only
    graph = M.neighbour_graph(near).where("url != 'p000' and neighbour != 'p000'").cache()
    start.count(), graph.count()
    spark.sparkContext.setJobGroup("big site", "")
    found = M.layout(start, graph, rounds=16, local_pages=30).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("big site"))
    spark.sparkContext.setJobGroup("", "")
    assert sorted(r.url for r in found) == [r[1] for r in rows] and {r.rounds for r in found} == {16}
    assert np.isfinite([r.coords for r in found]).all()
    layout = spark.createDataFrame(found)
    assert M.kept_neighbours(near, layout, 2, 8).first().kept > M.kept_neighbours(near, start, 2, 8).first().kept
    assert jobs < 60, jobs
