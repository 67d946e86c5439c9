"""Text column functions: cleaning, analysis form, previews, tokens and n-grams."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Sequence
from functools import cache
from pathlib import Path

import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.binding import bind
from sitegauge.functions.urls import _col

# Words dropped from page text before it is vectorised.
CONTENT_STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "because", "as", "what", "when", "where",
    "how", "to", "for", "with", "by", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "from", "up", "down", "in", "out", "on",
    "off", "over", "under", "again", "further", "then", "once", "here", "there", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very",
)

# Unicode white space, spelled so that it does not depend on regex flags.
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD = r"[\p{L}\p{N}_]"


@cache
def english_stop_words() -> tuple[str, ...]:
    """The English stop words that Spark ML ships, read from its library file."""
    home = Path(os.environ.get("SPARK_HOME") or Path(pyspark.__file__).parent)
    for library in sorted((home / "jars").glob("spark-mllib_*.jar")):
        with zipfile.ZipFile(library) as files:
            listed = files.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8")
        return tuple(w.strip() for w in listed.splitlines() if w.strip())
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def _drop_words(words: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return words
    # a long literal list becomes a hash set, which array_contains() would not
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def clean_text(text: Column | str) -> Column:
    """Collapse white space, then delete web addresses and e-mail addresses."""
    collapsed = F.regexp_replace(F.coalesce(_col(text), F.lit("")), f"[{SPACE}]+", " ")
    no_urls = F.regexp_replace(collapsed, r"https?://[^ ]+", "")
    no_mail = F.regexp_replace(no_urls, r"[^ ]+@[^ ]+", "")
    return F.trim(no_mail)


def analysis_words(text: Column | str) -> Column:
    """Words of two or more ASCII letters or digits, stop words dropped, in order."""
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    return _drop_words(
        F.regexp_extract_all(lowered, F.lit("[a-z0-9]{2,}"), F.lit(0)), CONTENT_STOP_WORDS
    )


def preprocess_text(text: Column | str) -> Column:
    """Text as it is vectorised; applying it twice changes nothing."""
    return F.array_join(analysis_words(text), " ")


def preview(text: Column | str, limit: int = 200) -> Column:
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def split_words(text: Column | str) -> Column:
    """White-space split without empty entries."""
    return F.filter(F.split(_col(text), f"[{SPACE}]+"), lambda w: w != "")


def reduction_percent(raw: Column | str, processed: Column | str) -> Column:
    raw_len, proc_len = F.length(_col(raw)), F.length(_col(processed))
    return F.when(raw_len > 0, 100 - proc_len / raw_len * 100).otherwise(F.lit(0.0))


def removed_words(raw: Column | str, processed: Column | str, limit: int = 50) -> Column:
    """Words of the raw text that the processed text lacks: the first *limit* in order."""
    gone = F.array_except(split_words(F.lower(_col(raw))), split_words(processed))
    return F.slice(F.array_sort(gone), 1, limit)


def word_count(processed: Column | str) -> Column:
    return F.size(split_words(processed))


def unique_words(processed: Column | str) -> Column:
    return F.size(F.array_distinct(F.filter(split_words(processed), lambda w: F.length(w) > 1)))


def lexical_diversity(processed: Column | str) -> Column:
    words = word_count(processed)
    return F.when(words > 0, unique_words(processed) / words).otherwise(F.lit(0.0))


def tokens(text: Column | str, min_length: int = 1, stop_words: Sequence[str] = ()) -> Column:
    """Lowercased runs of word characters, stop words dropped."""
    pattern = WORD + ("+" if min_length <= 1 else f"{{{min_length},}}")
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    return _drop_words(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0)), stop_words)


def _grams(w: Column, low: int, high: int) -> Column:
    run, parts = w, []
    for n in range(1, high + 1):
        if n > 1:
            # the shorter list is padded with null, and null text makes null runs
            behind = F.slice(w, n, F.greatest(F.size(w), F.lit(1)))
            run = F.filter(
                F.zip_with(run, behind, lambda a, b: F.concat(a, F.lit(" "), b)),
                lambda r: r.isNotNull(),
            )
        if n >= low:
            parts.append(run)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def ngrams(words: Column | str, low: int = 1, high: int = 1) -> Column:
    """All runs of *low* to *high* neighbouring words, joined by a blank."""
    if high == 1:
        return _col(words)
    return bind(_col(words), lambda w: _grams(w, low, high))
