"""From fetched robots.txt and sitemap bodies to page URLs.

Fetching is outside: *fetches* has ``domain, protocol, url, status, content_type, body``.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitegauge.functions.text import SPACE
from sitegauge.functions.urls import normalize_domain

# Where a sitemap may be when robots.txt names none.
WELL_KNOWN_PATHS = (
    "/sitemap.xml",
    "/sitemap_index.xml",
    "/sitemap-index.xml",
    "/sitemapindex.xml",
    "/wp-sitemap.xml",
    "/sitemap1.xml",
)

_LOC = r"(?is)<loc(?:\s[^>]*)?>(.*?)</loc\s*>"
_URL = r"(?is)<url(?:\s[^>]*)?>.*?</url\s*>"
_SITEMAP = r"(?is)<sitemap(?:\s[^>]*)?>.*?</sitemap\s*>"
_INDEX = r"(?is)<sitemapindex[\s>]"
_REFERENCE = r"&#?[A-Za-z0-9]{1,9};"
_ENCODING = r"^[^<]*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)"
_DECLARED = re.compile(_ENCODING)
HEAD_BYTES = 200


# Bodies of a batch that are decoded before they go into Arrow's memory.
DECODED_AT_ONCE = 256


def _text(body: bytes | None, zipped: bool, encoding: str | None) -> str | None:
    if body is None:
        return None
    try:
        plain = zlib.decompress(body, wbits=31) if zipped else body
    except zlib.error:
        return None
    if zipped:
        declared = _DECLARED.search(plain[:HEAD_BYTES].decode("latin-1"))
        encoding = declared[1] if declared else None
    if plain[:2] in (b"\xff\xfe", b"\xfe\xff"):
        encoding = "utf-16"
    try:
        return plain.decode(encoding or "utf-8", "replace").removeprefix("\ufeff")
    except LookupError:
        return plain.decode("utf-8", "replace")


@F.arrow_udf(StringType())
def _decoded(bodies: pa.Array, packed: pa.Array, encodings: pa.Array) -> pa.Array:
    """Unpacked and decoded bodies; null for a packed one that does not unpack."""
    parts = [pa.array([], pa.string())]
    for start in range(0, len(bodies), DECODED_AT_ONCE):
        rows = zip(*(column.slice(start, DECODED_AT_ONCE) for column in (bodies, packed, encodings)))
        parts.append(pa.array([_text(*(value.as_py() for value in row)) for row in rows], pa.string()))
    return pa.concat_arrays(parts)


def body_text(url: str = "url", body: str = "body") -> Column:
    """Body as text in the encoding it declares; a ``.gz`` body that does not unpack gives null.

    Plain UTF-8 bodies stay in the JVM.
    """
    packed, raw = F.col(url).endswith(".gz"), F.col(body).cast("binary")
    head = F.decode(F.substring(raw, 1, HEAD_BYTES), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(head, _ENCODING, 1))
    marked = head.startswith("\xff\xfe") | head.startswith("\xfe\xff") | head.startswith("\xef\xbb\xbf")
    special = packed | marked | ~declared.isin("", "utf-8", "utf8", "us-ascii")
    decoded = _decoded(F.when(special, raw), F.coalesce(packed, F.lit(False)), F.nullif(declared, F.lit("")))
    return F.when(special, decoded).otherwise(F.col(body).cast("string"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _character(reference: Column) -> Column:
    """What a character reference or one of the five named entities stands for; others stay."""
    body = F.substring(reference, F.lit(2), F.length(reference) - 2)
    digits = F.when(reference.rlike("^&#x[0-9A-Fa-f]{1,6};$"), F.substring(body, F.lit(3), F.length(body))).when(
        reference.rlike("^&#[0-9]{1,7};$"), F.hex(F.substring(body, F.lit(2), F.length(body)).cast("bigint"))
    )
    in_range = F.conv(digits, 16, 10).cast("bigint").between(1, 0xD7FF) | F.conv(digits, 16, 10).cast("bigint").between(0xE000, 0x10FFFF)
    coded = F.when(in_range, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
    named = None
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        named = (F if named is None else named).when(body == entity, F.lit(char))
    return F.coalesce(named, coded, reference)


def _xml_value(text: Column) -> Column:
    """Element text without CDATA marks and with character references resolved, each once."""
    value = F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", "")
    between, references = F.split(value, _REFERENCE, -1), F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0))
    resolved = F.zip_with(between, references, lambda b, r: F.concat(b, F.coalesce(_character(r), F.lit(""))))
    return _strip(F.array_join(resolved, ""))


def _uncommented(xml: Column) -> Column:
    return F.regexp_replace(xml, r"(?s)<!--.*?-->", "")


def _locs(xml: Column, element: str) -> Column:
    """First ``<loc>`` of every such element, in document order."""
    elements = F.regexp_extract_all(xml, F.lit(element), F.lit(0))
    values = F.transform(elements, lambda e: _xml_value(F.regexp_extract(e, _LOC, 1)))
    return F.filter(values, lambda v: v != "")


def robots_sitemaps(fetches: DataFrame) -> DataFrame:
    """Sitemaps named by robots.txt; those of plain http count only if https named none."""
    lines = fetches.filter((F.col("status") == 200) & F.col("url").endswith("/robots.txt")).select(
        normalize_domain("domain").alias("domain"),
        "protocol",
        F.explode(F.split(F.col("body").cast("string"), r"\R")).alias("line"),
    )
    named = lines.filter(F.lower("line").startswith("sitemap:")).select(
        "domain", "protocol", _strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("sitemap")
    )
    secure = named.filter(F.col("protocol") == "https").select("domain", "sitemap")
    plain = named.filter(F.col("protocol") == "http").select("domain", "sitemap")
    return secure.unionByName(
        plain.join(secure.select("domain").distinct(), "domain", "left_anti")
    ).distinct()


def candidate_sitemaps(fetches: DataFrame, robots: DataFrame) -> DataFrame:
    """Well-known sitemap locations that answered, for domains without a robots entry."""
    domain = normalize_domain("domain")
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1)
    found = fetches.filter(
        (F.col("status") == 200)
        & path.isin(*WELL_KNOWN_PATHS)
        & F.contains(F.coalesce("content_type", F.lit("")), F.lit("xml"))
    ).select(domain.alias("domain"), F.col("url").alias("sitemap"))
    return found.join(robots.select("domain").distinct(), "domain", "left_anti").distinct()


def expand_sitemap_index(sitemaps: DataFrame, fetches: DataFrame) -> DataFrame:
    """Replace sitemap indexes by their entries, one level deep."""
    bodies = fetches.filter(F.col("status") == 200).select(
        F.col("url").alias("sitemap"), body_text().alias("xml")
    )
    fetched = sitemaps.join(bodies, "sitemap").withColumn("xml", _uncommented(F.col("xml")))
    is_index = F.coalesce(F.col("xml").rlike(_INDEX), F.lit(False))
    entries = F.when(is_index, _locs(F.col("xml"), _SITEMAP)).otherwise(
        F.array(F.col("sitemap"))
    )
    return fetched.select("domain", F.explode(entries).alias("sitemap")).distinct()


def discover_sitemaps(fetches: DataFrame) -> DataFrame:
    """All sitemaps of every domain."""
    robots = robots_sitemaps(fetches)
    known = robots.unionByName(candidate_sitemaps(fetches, robots))
    return expand_sitemap_index(known, fetches)


def scan_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Page URLs of fetched sitemap bodies: ``sitemap, position, url``.

    *sitemaps* has ``url, body``; other columns are kept. Without any ``<url>`` entry,
    every ``<loc>`` that is not part of a ``<sitemap>`` counts.
    """
    kept = [c for c in sitemaps.columns if c not in ("url", "body")]
    xml = sitemaps.select(
        *kept, F.col("url").alias("sitemap"), _uncommented(body_text()).alias("xml")
    ).filter(F.col("xml").isNotNull())
    entries = _locs(F.col("xml"), _URL)
    bare = _locs(F.regexp_replace("xml", _SITEMAP, ""), _LOC)
    chosen = F.when(F.size(entries) > 0, entries).otherwise(bare)
    return xml.select(*kept, "sitemap", F.posexplode(chosen).alias("position", "url"))


def scan_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Page URLs of sitemap files (``.xml`` or ``.xml.gz``), by the rules of :func:`scan_sitemaps`.

    A file that does not unpack gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return scan_sitemaps(files.select(F.col("path").alias("url"), F.col("content").alias("body")))
