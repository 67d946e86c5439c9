"""Main text of fetched HTML pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitegauge.functions.text import clean_text, preprocess_text

# Elements without page content, and the id and class words of content.
DROPPED = frozenset(("script", "style", "nav", "header", "footer", "aside"))
CONTENT_ID = re.compile("content|main|post", re.I)
CONTENT_CLASS = re.compile("content|article|post", re.I)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_ROOTS = ("article", "main", "id", "class", "body")


class _TextOfRoots(HTMLParser):
    """Text nodes of the first element of every kind of content root."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.skip_from: int | None = None
        self.texts: dict[str, list[str]] = {}
        self.root_at: dict[str, int] = {}
        self.loose: list[str] = []
        self.pending: list[str] = []

    def _kinds(self, tag: str, attrs: list) -> list[str]:
        kinds = [tag] if tag in ("article", "main", "body") else []
        if tag == "div":
            given = dict(attrs)
            if CONTENT_ID.search(given.get("id") or ""):
                kinds.append("id")
            # a class attribute is a list of words; any of them may match
            if any(CONTENT_CLASS.search(w) for w in (given.get("class") or "").split()):
                kinds.append("class")
        return kinds

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in _VOID:
            return
        self.open.append(tag)
        depth = len(self.open)
        if self.skip_from is None and tag in DROPPED:
            self.skip_from = depth
        if self.skip_from is None:
            for kind in self._kinds(tag, attrs):
                if kind not in self.texts:
                    self.texts[kind] = []
                    self.root_at[kind] = depth

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag not in self.open:
            return
        while self.open:
            closed = self.open.pop()
            depth = len(self.open)
            self.root_at = {k: d for k, d in self.root_at.items() if d <= depth}
            if self.skip_from is not None and self.skip_from > depth:
                self.skip_from = None
            if closed == tag:
                return

    def handle_data(self, data):
        self.pending.append(data)

    def _flush(self) -> None:
        text = "".join(self.pending).strip()
        self.pending.clear()
        if not text or self.skip_from is not None:
            return
        for kind in self.root_at:
            self.texts[kind].append(text)
        if "head" not in self.open:
            self.loose.append(text)

    def close(self):
        super().close()
        self._flush()


def main_text(html: str | None) -> str:
    """Text of the most specific content root, pieces joined by one blank."""
    if not html:
        return ""
    parser = _TextOfRoots()
    parser.feed(html)
    parser.close()
    for kind in _ROOTS:
        if kind in parser.texts:
            return " ".join(parser.texts[kind])
    # a fragment without a body element is a body as a whole
    return " ".join(parser.loose)


@F.pandas_udf(StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def main_content(html: Column | str) -> Column:
    """Cleaned main text; only the HTML column travels to Python and back."""
    return clean_text(_main_text(F.col(html) if isinstance(html, str) else html))


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Raw and processed text per page."""
    raw = pages.select("site_id", "url", main_content(html).alias("raw_text"))
    return raw.withColumn("processed_text", preprocess_text("raw_text"))
