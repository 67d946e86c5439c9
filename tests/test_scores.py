import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegauge.operators import pairs as P
from sitegauge.operators import ranks as G
from sitegauge.operators import scores as S

# made up for these tests; what is expected of them is computed below with numpy
PLANE = [
    ("/garden", 1.0, -2.0),
    ("/garden/spade", 3.5, 0.25),
    ("/garden/rake", 3.25, 0.75),
    ("/notes/frost", -6.0, 2.5),
    ("/team", 0.0, 4.0),
    ("/team/history", 0.5, 4.5),
    ("/shed", 7.0, -1.0),
]
VECTORS = [[2.0, 0.5, 1.0], [0.25, 3.0, 1.5], [1.75, 0.75, 1.25], [1.0, 1.0, 4.0], [0.5, 2.5, 2.0]]


def plane(spark, points, site="s"):
    rows = [(site, f"https://example.com{u}", float(x), float(y)) for u, x, y in points]
    return spark.createDataFrame(rows, "site_id string, url string, x double, y double")


def space(spark, vectors, site="s"):
    rows = [(site, f"http://example.com/page{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "site_id string, url string, embedding array<double>")


def expected_scores(mean, largest, diameter, k1, k2):
    focus = 100 * np.exp(-k1 * mean / diameter)
    return focus, 100 * (1 - np.exp(-k2 * largest / diameter))


@pytest.mark.parametrize("k1,k2", [(5, 5), (15, 2)])
def test_planar_scores(spark, k1, k2):
    xy = np.array([p[1:] for p in PLANE])
    away = np.linalg.norm(xy - xy.mean(axis=0), axis=1)
    diameter = np.linalg.norm(xy[:, None] - xy[None], axis=2).max()
    row = S.planar_site_scores(plane(spark, PLANE), k1, k2).first()
    assert np.allclose([row.mean_distance, row.max_distance, row.diameter], [away.mean(), away.max(), diameter])


def test_planar_pairs(spark):
    points = plane(spark, PLANE)
    xy = np.array([p[1:] for p in PLANE])
    gaps = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    every = gaps[np.triu_indices(len(xy), 1)]
    found = P.near_duplicates(points, 1.0).orderBy("distance").collect()
    assert np.allclose([r.distance for r in found], sorted(every[every < 1.0])) and len(found) == 2
    stats = P.pair_distance_stats(P.plane_vectors(points), 2, group_rows=3).first()
    assert np.allclose([stats.min_distance, stats.max_distance, stats.mean_distance], [every.min(), every.max(), every.mean()])
    assert stats.near_zero == len(xy)
    away = np.linalg.norm(xy - xy.mean(axis=0), axis=1)
    ranks = {r.url: r.focus_rank for r in G.focus_rank(S.planar_distances(points)).collect()}
    for (name, *_), d in zip(PLANE, away):
        assert ranks[f"https://example.com{name}"] == pytest.approx(100 * (away < d).sum() / (len(xy) - 1), abs=1e-3)


def test_planar_edges(spark):
    assert S.planar_site_scores(plane(spark, [])).count() == 0
    one = S.planar_site_scores(plane(spark, [("/a", 3, 4)])).first()
    assert (one.focus_score, one.radius_score) == (100, 0)
    same = plane(spark, [("/a", 1, 1), ("/b", 1, 1), ("/c", 1, 1)])
    row = S.planar_site_scores(same).first()
    assert (row.focus_score, row.radius_score) == (100, 0)
    assert P.near_duplicates(same, 1.0).count() == 0
    stats = P.pair_distance_stats(P.plane_vectors(same), 2).first()
    assert stats.near_zero == 9 and stats.min_distance is None and stats.pairs == 3


def test_vector_scores(spark):
    vectors = space(spark, VECTORS)
    row = S.vector_site_scores(vectors, 3).first()
    distance = brute(VECTORS)
    assert row.diameter == pytest.approx(distance.max(), abs=1e-9)
    assert 0 < row.focus_score < 100 and 0 < row.radius_score < 100
    pairs = P.cannibalization(vectors, 3).orderBy("rank").collect()
    order = sorted((distance[i, j], i, j) for i in range(len(VECTORS)) for j in range(i + 1, len(VECTORS)))
    near = [(str(i), str(j)) for d, i, j in order if d <= P.CANNIBAL_DISTANCE]
    assert [(r.url1[-1], r.url2[-1]) for r in pairs] == near and near
    assert pairs[0].similarity == pytest.approx(1 - order[0][0], abs=1e-9)


def test_vector_edges(spark):
    one = S.project_results(space(spark, [[1, 2, 3]]), 3).first()
    assert (round(one.focus_score, 6), one.radius_score, one.pairs) == (100, 0, [])
    broken = spark.createDataFrame(
        [("s", "a", [1.0, 2.0]), ("s", "b", None), ("s", "c", [1.0]), ("s", "d", [1.0, float("nan")])],
        "site_id string, url string, embedding array<double>",
    )
    assert [r.url for r in P.usable_vectors(broken, 2).collect()] == ["a"]
    assert P.rejected_vectors(broken, 2).first().rejected == 3
    # a zero vector is at distance one from everything
    assert P.diameter_cosine(space(spark, [[1, 0], [0, 0], [1, 0]]), 2).first().diameter == 1


@pytest.mark.parametrize("size", [5, 1000])
def test_site_rows_of_one_pass_against_brute_force(spark, size):
    rng = np.random.default_rng(11)
    sites = {
        "mixed": rng.normal(size=(40, 4)).round(1).tolist() + [[1.0, 0.5, 0.2, 0.1]] * 30,
        "narrow": (np.array([1.0, 1, 1, 1]) + rng.normal(scale=0.1, size=(50, 4))).tolist(),
        "zeros": [[0.0] * 4] * 7,
        "zero": [[1.0, 0.0, 0.0, 0.0], [0.0] * 4, [1.0, 0.1, 0.0, 0.0]],
        "one": [[1.0, 2.0, 3.0, 4.0]],
    }
    rows = [(s, f"http://example.com/{s}{i}", v) for s, vs in sites.items() for i, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "site_id string, url string, embedding array<double>")
    spans = {r.site_id: r for r in S.vector_site_scores(frame, 4, group_rows=size).collect()}
    whole = {r.site_id: r for r in S.project_results(frame, 4, max_distance=0.3, limit=40, group_rows=size).collect()}
    assert set(spans) == set(whole) == set(sites)
    for site, vectors in sites.items():
        distance, array = brute(vectors), np.array(vectors)
        zero = ~array.any(axis=1)
        distance[np.ix_(zero, zero)] = 1
        np.fill_diagonal(distance, 0)
        unit = brute([*vectors, array.mean(axis=0).tolist()])[-1, :-1]
        for row in (spans[site], whole[site]):
            assert row.total == len(vectors) and len(row.centroid) == 4
            assert row.diameter == pytest.approx(distance.max(), abs=1e-9)
            assert (row.mean_distance, row.max_distance) == pytest.approx((unit.mean(), unit.max()), abs=1e-9)
        best = P.cannibalization(frame.filter(F.col("site_id") == site), 4, 0.3, 40).orderBy("rank").collect()
        assert [(p.url1, p.url2) for p in whole[site].pairs] == [(p.url1, p.url2) for p in best]
        assert [p.similarity for p in whole[site].pairs] == pytest.approx([p.similarity for p in best], abs=1e-9)


def test_site_rows_read_the_vectors_few_times(spark):
    from sitegauge.plans import catalog

    for name, most in (("f7_f8_vector_scores", 6), ("f15_project_result", 6)):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("Relation [") <= most, name


def brute(vectors):
    unit = np.array([v / np.linalg.norm(v) if np.linalg.norm(v) else v * 0 for v in np.array(vectors, float)])
    distance = np.clip(1 - unit @ unit.T, 0, 2)
    np.fill_diagonal(distance, 0)
    return distance


def test_copies_and_small_cells_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 4)).round(1).tolist()
    vectors += [vectors[0]] * 30  # a third of all rows are copies of one page
    distance = brute(vectors)
    names = [f"http://example.com/page{i}" for i in range(len(vectors))]
    frame = space(spark, vectors)
    expected = sorted(
        (round(distance[i, j], 9), *sorted((names[i], names[j])))
        for i in range(len(vectors)) for j in range(i)
        if distance[i, j] < 0.3
    )
    for size in (7, 1000):
        got = P.cannibalization(frame, 4, 0.3, 40, group_rows=size).orderBy("rank").collect()
        assert [(r.url1, r.url2) for r in got] == [(a, b) for _, a, b in expected[:40]]
        widest = P.diameter_cosine(frame, 4, group_rows=size).first().diameter
        assert widest == pytest.approx(distance.max(), abs=1e-9)
        near = P.nearest_pages(frame, 4, 5, group_rows=size).collect()
        assert len(near) == 5 * len(vectors)
        for i in (0, 5, 61, 89):
            order = sorted((round(distance[i, j], 9), names[j]) for j in range(len(vectors)) if j != i)
            mine = [r.neighbour for r in sorted(near, key=lambda r: r["rank"]) if r.url == names[i]]
            assert mine == [n for _, n in order[:5]]


points_strategy = st.lists(
    st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=40
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(points_strategy)
def test_planar_properties(spark, places):
    points = plane(spark, [(f"/{i:03d}", x / 4, y / 4) for i, (x, y) in enumerate(places)])
    xy = np.array(places) / 4
    distance = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    row = S.planar_site_scores(points).first()
    assert row.diameter == pytest.approx(distance.max(), abs=1e-9)
    assert 0 <= row.focus_score <= 100 and 0 <= row.radius_score <= 100
    if row.diameter > 0:
        assert 0.5 - 1e-6 <= row.max_distance / row.diameter <= 1 + 1e-6
    found = P.near_duplicates(points, 1.3, rows_per_subcell=3)
    expected = sum(
        1e-9 < distance[i, j] < 1.3 for i in range(len(xy)) for j in range(i)
    )
    pairs = [(r.url1, r.url2) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) == expected
