"""The given tables seen as sites, pages, vectors and status logs."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sitegauge.functions.urls import host
from sitegauge.sources.html import page_text as extract_page_text

EMBEDDING_SIZE = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Path templates by order number; N stands for the order number.
URL_SHAPES = (
    "/",
    "/blog/2023/01/post-N",
    "/news/story_N.html",
    "/product/N",
    "/p/N",
    "/category/red+hats/N",
    "/about",
    "/help/topic-N.php",
    "/contact",
    "/products/A-B+c/N.PHP?page=2",
    "/a/b/c/d.N/e.htm#top",
    "/index.html",
)


def url_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """``site_id, order_key, sitemap, url`` from orders: every page type and path form."""
    orders = table(spark, folder, "orders")
    shapes = F.array(*[F.lit(s) for s in URL_SHAPES])
    shape = F.get(shapes, F.pmod("o_orderkey", F.lit(len(URL_SHAPES))).cast("int"))
    path = F.replace(shape, F.lit("N"), F.col("o_orderkey").cast("string"))
    site = F.concat(F.lit("site"), F.pmod("o_custkey", F.lit(20)).cast("string"))
    return orders.select(
        site.alias("site_id"),
        F.col("o_orderkey").alias("order_key"),
        F.concat(F.lit("https://"), site, F.lit(".example.com/sitemap-"),
                 F.lower(F.substring("o_orderpriority", 1, 1)), F.lit(".xml")).alias("sitemap"),
        F.concat(F.lit("https://"), site, F.lit(".example.com"), path).alias("url"),
    )


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``site_id, url, source_sitemap, html`` from pages; the host is the site."""
    pages = table(spark, folder, "pages")
    site = host("url")
    language = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    return pages.select(
        site.alias("site_id"),
        "url",
        F.concat(F.lit("https://"), site, F.lit("/sitemap-"), language, F.lit(".xml")).alias(
            "source_sitemap"
        ),
        "page_id",
        "html",
    )


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_page_text(site_pages(spark, folder))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``site_id, url, embedding`` from embeddings; the label is the site."""
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("site_id"),
        F.concat(F.lit("https://example.com/v/"), F.col("vec_id").cast("string")).alias("url"),
        "embedding",
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    """The first two vector components as fixed coordinates."""
    v = F.col("embedding")
    return vectors(spark, folder).select(
        "site_id", "url", v[0].cast("double").alias("x"), v[1].cast("double").alias("y")
    )


def doc_site(spark: SparkSession, folder: str, site: str = "lang") -> DataFrame:
    """``site_id, url, text`` from documents; language or source is the site."""
    return table(spark, folder, "documents").select(
        F.col(site).alias("site_id"), F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("url"), "text"
    )


_STATUS = {
    "signup": "pending",
    "view": "processing",
    "purchase": "completed",
    "click": "skipped",
    "error": "failed",
}


def status_log(spark: SparkSession, folder: str) -> DataFrame:
    """``project, url, status, error_message, ts`` from events."""
    events = table(spark, folder, "events")
    status = F.lit(None).cast("string")
    for kind, meaning in _STATUS.items():
        status = F.when(F.col("event_type") == kind, meaning).otherwise(status)
    return events.select(
        F.concat(F.lit("project "), F.pmod("user_id", F.lit(10)).cast("string")).alias("project"),
        F.concat(F.lit("u"), F.pmod("event_id", F.lit(500)).cast("string")).alias("url"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def page_points(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed coordinates for the given pages, made of their size and number."""
    return site_pages(spark, folder).select(
        "site_id",
        "url",
        (F.length("html") / 1000.0).alias("x"),
        (F.col("page_id") / 100.0).alias("y"),
    )


# Pages per generated sitemap, sitemaps per generated index.
SITEMAP_PAGES = 50
INDEX_SITEMAPS = 20


@F.arrow_udf(BinaryType())
def _gzip(texts: pa.Array) -> pa.Array:
    return pa.array([gzip.compress(t.as_py().encode(), mtime=0) if t.is_valid else None for t in texts], pa.binary())


def _sitemap_names(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the generated sitemap and sitemap index that list them."""
    chunk = F.floor(F.col("page_id") / SITEMAP_PAGES)
    base = F.regexp_replace("source_sitemap", r"\.xml$", "-")
    packed = F.when(F.pmod(chunk, F.lit(2)) == 1, ".xml.gz").otherwise(".xml")
    return site_pages(spark, folder).select(
        F.col("site_id").alias("domain"),
        "page_id",
        "url",
        F.concat(base, chunk.cast("string"), packed).alias("sitemap"),
        F.concat(base, F.lit("i"), F.floor(chunk / INDEX_SITEMAPS).cast("string"), F.lit(".xml")).alias("index"),
    )


def sitemap_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """``domain, url, body``: one body per generated sitemap, every second one gzipped."""
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    entry = F.concat(
        F.lit("<url><loc> "), escaped,
        F.lit(" </loc><image:image><image:loc>https://img/x.png</image:loc></image:image></url>\n"),
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("page_id", entry.alias("entry")))), lambda e: e["entry"]
    )
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(listed, ""), F.lit("</urlset>"))
    # a sitemap lists at most SITEMAP_PAGES pages
    bodies = _sitemap_names(spark, folder).groupBy("domain", "sitemap").agg(xml.alias("xml"))
    packed = F.col("sitemap").endswith(".gz")
    return bodies.select(
        "domain",
        F.col("sitemap").alias("url"),
        F.when(packed, _gzip(F.when(packed, F.col("xml")))).otherwise(F.col("xml").cast("binary")).alias("body"),
    )


def sitemap_fetches(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched robots.txt files, sitemap indexes and sitemaps of the given hosts.

    Hosts of even name length have an https robots.txt that names their indexes; hosts
    whose length is divisible by three have an http one; every host answers at
    /sitemap.xml, as XML, and at /sitemap1.xml, as HTML.
    """
    names = _sitemap_names(spark, folder)
    robots = names.select("domain", "index").distinct().groupBy("domain").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list("index")),
                lambda i: F.concat(F.lit("SiteMap:  "), i, F.lit(" \r\n# sitemap: none\n")),
            ),
            "",
        ).alias("lines")
    )
    length = F.length("domain")
    xml_type, html_type = F.lit("application/xml; charset=utf-8"), F.lit("text/html")

    def fetch(rows, protocol, path, status, kind, body):
        return rows.select(
            "domain",
            F.lit(protocol).alias("protocol"),
            F.concat(F.lit(protocol + "://"), F.col("domain"), F.lit(path)).alias("url"),
            status.cast("int").alias("status"),
            kind.alias("content_type"),
            body.cast("binary").alias("body"),
        )

    ok = F.lit(200)
    hosts = robots.select("domain")
    even = F.when(F.pmod(length, F.lit(2)) == 0, 200).otherwise(404)
    third = F.when(F.pmod(length, F.lit(3)) == 0, 200).otherwise(404)
    old = F.concat(F.lit("Sitemap: http://"), F.col("domain"), F.lit("/old.xml"))
    entry = F.concat(F.lit("<sitemap><loc>"), F.col("sitemap"), F.lit("</loc></sitemap>"))
    indexes = (
        names.select("domain", "index", "sitemap")
        .distinct()
        .groupBy("domain", "index")
        .agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("entries"))
    )
    parts = [
        fetch(robots, "https", "/robots.txt", even, F.lit("text/plain"), F.concat(F.lit("User-agent: *\n"), F.col("lines"))),
        fetch(hosts, "http", "/robots.txt", third, F.lit("text/plain"), old),
        fetch(hosts, "https", "/sitemap.xml", ok, xml_type, F.lit("<urlset></urlset>")),
        fetch(hosts, "https", "/sitemap1.xml", ok, html_type, F.lit("<html></html>")),
        fetch(hosts, "http", "/wp-sitemap.xml", F.lit(404), xml_type, F.lit("")),
        indexes.select(
            "domain", F.lit("https").alias("protocol"), F.col("index").alias("url"), ok.alias("status"),
            xml_type.alias("content_type"),
            F.concat(F.lit("<sitemapindex>"), F.col("entries"), F.lit("</sitemapindex>")).cast("binary").alias("body"),
        ),
        sitemap_bodies(spark, folder).select(
            "domain", F.lit("https").alias("protocol"), "url", ok.alias("status"),
            xml_type.alias("content_type"), "body",
        ),
    ]
    fetches = parts[0]
    for part in parts[1:]:
        fetches = fetches.unionByName(part)
    return fetches
