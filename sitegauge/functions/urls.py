"""URL column functions: path clean-up, page type, depth, filters, identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions dropped from a path, and the page-type patterns in the
# order in which they are tried.
PAGE_EXTENSIONS = ("html", "htm", "php", "aspx", "jsp", "asp")
HOME_PATHS = ("/", "/index.html", "/index.php", "/index.asp")
PAGE_TYPE_SEGMENTS = (
    ("Blog", ("blog", "article", "post", "news"), r"/\d{4}/\d{2}(?:/\d{2})?(?:/|$)"),
    ("Product", ("product", "item", "sku", "shop"), r"/p/[\p{L}\p{N}_]"),
    ("Category", ("category", "cat", "collection", "department", "section"), None),
    ("Info", ("about", "company", "team", "history", "mission", "faq", "help", "support"), None),
    ("Contact", ("contact", "reach-us", "get-in-touch"), None),
)

# RFC 3986 split; parse_url() would reject URLs with blanks.
_PATH = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_path(url: Column | str) -> Column:
    """Path of a URL without query, fragment and the ``;params`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(_col(url), _PATH, 1), r";[^/]*$", "")


def host(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^(?:[^:/?#]+:)?//([^/?#]*)", 1)


def process_url_path(url: Column | str) -> Column:
    """Words of the path: separators to blanks, page extension dropped, lowercased."""
    bare = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    spaced = F.translate(bare, "-_/+", "    ")
    extension = r"\.(?:" + "|".join(PAGE_EXTENSIONS) + r")$"
    return F.lower(F.regexp_replace(spaced, extension, ""))


def page_type(url: Column | str) -> Column:
    path = F.lower(url_path(url))
    kind = F.when((path == "") | path.isin(*HOME_PATHS), "Home")
    for name, segments, extra in PAGE_TYPE_SEGMENTS:
        pattern = "/(?:" + "|".join(segments) + ")(?:/|$)"
        if extra:
            pattern += "|" + extra
        kind = kind.when(path.rlike(pattern), name)
    return kind.otherwise("Other")


def page_depth(url: Column | str) -> Column:
    """Number of path segments, a trailing file name not counted."""
    path = url_path(url)
    is_file = path.rlike(r"\.[^/]*$").cast("int")
    return F.regexp_count(path, F.lit("[^/]+")) - is_file


def contains_ignore_case(text: Column | str, term: str) -> Column:
    """Literal substring test, as the inspector's search box does."""
    return F.contains(F.lower(_col(text)), F.lower(F.lit(term)))


def matches_ignore_case(text: Column | str, pattern: str) -> Column:
    """Regular-expression test, as the detail table's search box does."""
    return _col(text).rlike("(?i)" + pattern)


def url_filter(
    url: Column | str,
    includes: Sequence[str] = (),
    excludes: Sequence[str] = (),
    match_any: bool = True,
) -> Column:
    """Any exclude term rejects; then ANY or ALL of the include terms must occur."""
    keep = F.lit(True)
    for term in filter(None, excludes):
        keep = keep & ~contains_ignore_case(url, term)
    wanted = [contains_ignore_case(url, term) for term in includes if term]
    if wanted:
        test = wanted[0]
        for other in wanted[1:]:
            test = (test | other) if match_any else (test & other)
        keep = keep & test
    return keep


def sitemap_term_filter(url: Column | str, include: str | None, exclude: str | None) -> Column:
    """One include and one exclude term; blank terms switch the test off."""
    return url_filter(url, [(include or "").strip()], [(exclude or "").strip()])


def detail_filter(
    search: str | None = None,
    kind: str = "All",
    sitemap: str = "All",
    url: str = "url",
    type_column: str = "page_type",
    sitemap_column: str = "source_sitemap",
) -> Column:
    keep = F.lit(True)
    if search:
        keep = keep & matches_ignore_case(url, search)
    if kind != "All":
        keep = keep & (F.col(type_column) == kind)
    if sitemap != "All":
        keep = keep & (F.col(sitemap_column) == sitemap)
    return keep


def sanitize_name(name: Column | str) -> Column:
    """Project name rule; an empty result means the name is rejected."""
    return F.regexp_replace(F.translate(F.lower(_col(name)), " -", "__"), r"[^\p{L}\p{N}_]", "")


def normalize_domain(domain: Column | str) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(_col(domain))), r"^https?://", "")
    return F.regexp_replace(bare, r"/+$", "")


def point_id(url: Column | str) -> Column:
    return F.sha2(_col(url), 256)


def numbered_list(urls: Column | str, limit: int = 5, empty: str | None = None) -> Column:
    """``1. a\\n2. b\\n…`` for the first *limit* entries, then a count of the rest.

    With *empty* set, an empty list gives that text and the result is trimmed.
    """
    items = _col(urls)
    lines = F.transform(
        F.slice(items, 1, limit),
        lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item, F.lit("\n")),
    )
    rest = F.size(items) - limit
    tail = F.when(
        rest > 0, F.concat(F.lit("... and "), rest.cast("string"), F.lit(" more\n"))
    ).otherwise("")
    text = F.concat(F.array_join(lines, ""), tail)
    if empty is None:
        return text
    return F.when(F.size(items) == 0, empty).otherwise(F.rtrim(text, F.lit("\n")))
