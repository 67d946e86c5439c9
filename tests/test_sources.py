import gzip
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import topicmap as M
from sitegauge.plans import catalog
from sitegauge.sources import sitemaps as X
from sitegauge.sources import store as W
from sitegauge.streaming import status as TS
from sitegauge.streaming.ingest import ingest_stream

FETCH = "domain string, protocol string, url string, status int, content_type string, body binary"


def scan(spark, *bodies):
    frame = spark.createDataFrame([(u, b) for u, b in bodies], "url string, body binary")
    return [(r.sitemap, r.url) for r in X.scan_sitemaps(frame).orderBy("sitemap", "position").collect()]


def test_scan_sitemaps(spark):
    urlset = (
        b"<urlset><url><loc> https://e.com/a?x=1&amp;y=2 </loc><image:image><image:loc>i</image:loc></image:image></url>"
        b"<!-- <url><loc>no</loc></url> --><url><loc><![CDATA[https://e.com/b]]></loc></url></urlset>"
    )
    expected = ["https://e.com/a?x=1&y=2", "https://e.com/b"]
    assert scan(spark, ("s.xml", urlset)) == [("s.xml", u) for u in expected]
    assert scan(spark, ("s.xml.gz", gzip.compress(urlset))) == [("s.xml.gz", u) for u in expected]
    # a body that is no gzip gives no rows and does not stop the others
    found = scan(spark, ("bad.xml.gz", urlset), ("list.xml", b"<list><loc>u1</loc><sitemap><loc>s1</loc></sitemap></list>"))
    assert found == [("list.xml", "u1")]


def test_discovery(spark):
    ok = "text/plain"
    rows = [
        ("E.com", "https", "https://e.com/robots.txt", 200, ok, b"Sitemap: https://e.com/i.xml\r\nSITEMAP:x\n# sitemap: no"),
        ("e.com", "http", "http://e.com/robots.txt", 200, ok, b"Sitemap: http://e.com/never.xml"),
        ("e.com", "https", "https://e.com/i.xml", 200, "text/xml", b"<sitemapindex><sitemap><loc>s1</loc></sitemap></sitemapindex>"),
        ("f.com", "https", "https://f.com/robots.txt", 404, ok, b"Sitemap: gone"),
        ("f.com", "http", "http://f.com/robots.txt", 200, ok, b"Sitemap: http://f.com/m.xml"),
        ("f.com", "http", "http://f.com/m.xml", 200, ok, b"<urlset/>"),
        ("g.com", "http", "http://g.com/sitemap.xml", 200, "application/xml", b"<urlset/>"),
        ("g.com", "http", "http://g.com/sitemap1.xml", 200, "text/html", b"<urlset/>"),
    ]
    fetches = spark.createDataFrame([(*r[:5], bytearray(r[5])) for r in rows], FETCH)
    found = sorted((r.domain, r.sitemap) for r in X.discover_sitemaps(fetches).collect())
    assert found == [("e.com", "s1"), ("f.com", "http://f.com/m.xml"), ("g.com", "http://g.com/sitemap.xml")]


@pytest.mark.parametrize("text,count", [("https://a.b/1,x\nhttps://a.b/2\n", 2), ("", 0), ("url\nhttps://a.b/1\n https://a.b/1 \n\n", 1)])
def test_url_list(spark, tmp_path, text, count):
    (tmp_path / "urls.csv").write_text(text)
    urls, rejected = W.read_url_list(spark, str(tmp_path), "p")
    assert urls.count() == count
    assert [r.url for r in rejected.collect()] == (["url"] if text.startswith("url") else [])


def test_store_upsert_replaces_and_skips(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "project string, url string, content_md string, embedding array<float>"
    first = spark.createDataFrame([("p", "u1", "a", [1.0]), ("q", "u1", "a", [1.0])], schema)
    again = spark.createDataFrame([("p", "u1", "b", [2.0]), ("p", "u2", "b", [2.0])], schema)
    assert W.read_store(spark, path).count() == 0
    for batch in (first, again, again):
        W.upsert_vectors(spark, path, batch, buckets=2)
    rows = {(r.project, r.url): r.content_md for r in W.read_store(spark, path).collect()}
    assert rows == {("p", "u1"): "b", ("q", "u1"): "a", ("p", "u2"): "b"}
    assert W.scan_project(spark, path, "q").count() == 1
    new = W.skip_processed(spark.createDataFrame([("p", "u2"), ("q", "u2")], "project string, url string"), W.read_store(spark, path))
    assert [(r.project, r.url) for r in new.collect()] == [("q", "u2")]


def test_store_keeps_its_bucket_count(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("p", f"u{i}", "t", [float(i)]) for i in range(8)]
    batch = spark.createDataFrame(rows, "project string, url string, content_md string, embedding array<float>")
    W.upsert_vectors(spark, path, batch, buckets=2)
    W.upsert_vectors(spark, path, batch.withColumn("content_md", F.lit("again")), buckets=4)
    stored = W.read_store(spark, path).collect()
    assert len(stored) == 8 and {r.content_md for r in stored} == {"again"}
    assert W.store_layout(spark, path).buckets == 2


def test_upsert_reads_and_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "project string, url string, content_md string, embedding array<float>"
    batch = spark.createDataFrame([("p", f"u{i}", "t", [1.0]) for i in range(50)], schema)
    W.upsert_vectors(spark, path, batch, buckets=8)
    before = W.store_layout(spark, path)
    one = batch.filter("url = 'u7'")
    read = W.stored_beside(spark, path, one)
    assert 0 < read.count() < 50 and len({f.rsplit("/", 2)[1] for f in read.inputFiles()}) == 1
    W.upsert_vectors(spark, path, one.withColumn("content_md", F.lit("new")))
    after = W.store_layout(spark, path)
    changed = [b for b in after.versions if after.versions[b] != before.versions.get(b)]
    assert len(changed) == 1 and W.read_store(spark, path).count() == 50
    # equal ids in a batch: the same row stays whatever the order of rows
    twice = spark.createDataFrame([("p", "x", "a", [1.0]), ("p", "x", "b", [0.0])], schema)
    for rows in (twice, twice.orderBy(F.desc("content_md"))):
        W.upsert_vectors(spark, path, rows)
        assert [r.content_md for r in W.read_store(spark, path).filter("url = 'x'").collect()] == ["b"]


def test_ingest_leaves_unusable_pages_for_later(spark, tmp_path):
    schema = "project string, url string, content_md string, embedding array<float>"
    rows = [("p", "u1", None, None), ("p", "u2", "t", [1.0]), ("p", "u3", "t", []), ("p", "u4", "", [1.0])]
    arrivals, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in (rows, [("p", "u1", "now", [2.0]), ("p", "u1", "nov", [3.0])]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
        ingest_stream(stream, store, str(tmp_path / "check"), buckets=2).awaitTermination()
    stored = {r.url: r.content_md for r in W.read_store(spark, store).collect()}
    assert stored == {"u1": "now", "u2": "t"}


def test_sitemap_files(spark, tmp_path):
    (tmp_path / "good.xml").write_bytes(b"<urlset><url><loc>https://e.com/?x=1&#38;y=2&#x26;z&amp;#38;</loc></url></urlset>")
    (tmp_path / "bare.xml.gz").write_bytes(gzip.compress(b"<list><loc>u1</loc></list>"))
    (tmp_path / "bad.xml.gz").write_bytes(b"<urlset><url><loc>never</loc></url></urlset>")
    latin = "<?xml version='1.0' encoding='ISO-8859-1'?><urlset><url><loc>https://e.com/\u00e9</loc></url></urlset>"
    (tmp_path / "latin.xml").write_bytes(latin.encode("latin-1"))
    (tmp_path / "latin.xml.gz").write_bytes(gzip.compress(latin.encode("latin-1")))
    (tmp_path / "wide.xml").write_bytes("<urlset><url><loc>\U0001f600</loc></url></urlset>".encode("utf-16"))
    found = {(r.sitemap.rsplit("/", 1)[1], r.url) for r in X.scan_sitemap_files(spark, str(tmp_path)).collect()}
    assert found == {
        ("good.xml", "https://e.com/?x=1&y=2&z&#38;"),
        ("bare.xml.gz", "u1"),
        ("latin.xml", "https://e.com/\u00e9"),
        ("latin.xml.gz", "https://e.com/\u00e9"),
        ("wide.xml", "\U0001f600"),
    }
    mixed = b"<urlset><url><loc>&#128512;&#xE9;&#0;&#xD800;&lt;&unknown;</loc></url></urlset>"
    assert scan(spark, ("s.xml", mixed)) == [("s.xml", "\U0001f600\u00e9&#0;&#xD800;<&unknown;")]


def test_saved_parameters(spark, tmp_path):
    W.save_analysis(spark, str(tmp_path), "a", {"exclude_filters": ["1", "2", "3", "4"], "api_key": "k"}, {})
    params, tables = W.load_analysis(spark, str(tmp_path), "a", {"missing": "x int"})
    assert params["exclude_filters"] == ["1", "2", "3"] and params["max_urls"] == 100
    assert "api_key" not in params and tables["missing"].count() == 0


def test_status_counts_once_and_late_events_do_not_win(spark, tmp_path):
    at = [datetime(2024, 1, 1, 0, 0, s) for s in range(4)]
    rows = [
        ("p", "u1", "pending", None, at[0]),
        ("p", "u1", "completed", None, at[2]),
        ("p", "u1", "processing", None, at[1]),
        ("p", "u2", "failed", "x", at[1]),
        ("q", "u1", "pending", None, at[0]),
    ]
    log = spark.createDataFrame(rows, "project string, url string, status string, error_message string, ts timestamp")
    counts = {r.project: tuple(r)[1:] for r in TS.status_rollup(log).collect()}
    assert counts == {"p": (2, 1, 0, 1), "q": (1, 0, 1, 0)}
    source = str(tmp_path / "log")
    log.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    TS.status_stream(stream, str(tmp_path / "out")).awaitTermination()
    assert {r.project: tuple(r)[1:] for r in TS.current_counts(spark, str(tmp_path / "out")).collect()} == counts
    assert [r.project for r in TS.completions(spark, str(tmp_path / "out")).collect()] == ["p"]


def test_pca_small_and_shared_paths(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5)) * [5, 3, 2, 1, 0.5]
    frame = spark.createDataFrame(
        [("s", f"u{i:02d}", [float(v) for v in row]) for i, row in enumerate(x)],
        "site_id string, url string, embedding array<double>",
    )
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:3]
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]
    for size in (7, 1000):
        got = M.pca(frame, 5, 3, group_rows=size).orderBy("url").collect()
        assert np.allclose([r.coords for r in got], centred @ axes.T, atol=1e-8)
    few = M.pca(frame.filter("url < 'u02'"), 5, 3).orderBy("url").collect()
    assert [len(r.coords) for r in few] == [3, 3] and np.allclose([r.coords[1:] for r in few], 0, atol=1e-6)


def test_layout_keeps_neighbours(spark):
    rng = np.random.default_rng(2)
    centers = np.eye(3, 6) * 5
    rows = [
        ("s", f"c{c}-{i:02d}", [float(v) for v in centers[c] + rng.normal(scale=0.3, size=6)])
        for c in range(3)
        for i in range(20)
    ] + [("lone", "x", [1.0] * 6)]
    frame = spark.createDataFrame(rows, "site_id string, url string, embedding array<double>")
    got = M.neighbour_map(frame, 6, 2, "umap", neighbours=5, rounds=6, lone_pages=True).collect()
    assert [r.coords for r in got if r.site_id == "lone"] == [[0.0, 0.0]]
    laid = [r for r in got if r.site_id == "s"]
    place = np.array([r.coords for r in laid])
    gap = ((place[:, None] - place[None]) ** 2).sum(axis=2)
    np.fill_diagonal(gap, np.inf)
    same = [laid[i].url[:2] == laid[j].url[:2] for i, j in enumerate(gap.argmin(axis=1))]
    assert len(laid) == 60 and np.mean(same) > 0.9


def test_only_packed_bodies_pass_through_python(spark):
    import zlib

    from sitegauge.plans import inputs as I

    packed = zlib.compress(b"<urlset>\xc3\xa9</urlset>", wbits=31)
    rows = [(f"u{i}.xml.gz", packed if i % 3 else b"no gzip") for i in range(600)] + [("u.xml", "<urlset>é</urlset>".encode()), ("n.xml.gz", None)]
    bodies = spark.createDataFrame(rows, "url string, body binary").coalesce(1)
    found = {r.url: r.text for r in bodies.select("url", X.body_text().alias("text")).collect()}
    assert found["n.xml.gz"] is None and found["u.xml"] == "<urlset>é</urlset>"
    assert all(found[f"u{i}.xml.gz"] == ("<urlset>é</urlset>" if i % 3 else None) for i in range(600))
    # plain sitemaps go to the packing function as nulls
    texts = spark.createDataFrame([("a",), (None,)], "text string").coalesce(1)
    assert [r.out is None for r in texts.select(I._gzip("text").alias("out")).collect()] == [False, True]


def test_sitemap_files_lie_in_few_folders(spark, tmp_path, monkeypatch):
    """One file a sitemap, but no folder for each: folders are made, moved and listed one by one."""
    rows = [(k, f"https://host{k}.example.com/en/page-{k}", "<html></html>") for k in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(catalog, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    found = catalog.QUERIES["a5_scan_sitemap_files"](spark, str(tmp_path)).collect()
    assert sorted(r["url"] for r in found) == sorted(r[1] for r in rows)
    files = list((tmp_path / "sitemaps").glob("*/part-*"))
    assert len(files) == 300 and len({f.parent for f in files}) < 250
