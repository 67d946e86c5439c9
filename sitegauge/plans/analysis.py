"""The two whole analyses: from text to scored pages, and from stored vectors to results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import process_url_path, url_filter
from sitegauge.operators import pairs as P
from sitegauge.operators import scores as S
from sitegauge.operators import tfidf as D
from sitegauge.operators.dedup import cap_urls, merge_sitemap_urls
from sitegauge.operators.topicmap import coordinates, term_map
from sitegauge.session import stored


@dataclass(frozen=True)
class AnalysisOptions:
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    match_any: bool = True
    max_urls: int | None = None
    use_content: bool = True
    use_paths: bool = True
    url_weight: float = 0.3
    perplexity: float = 15.0
    k1: float = 5.0
    k2: float = 5.0
    rounds: int | None = None
    stop_words: tuple[str, ...] = field(default_factory=D.library_stop_words)


def choose_urls(listed: DataFrame, options: AnalysisOptions) -> DataFrame:
    """Listed sitemap entries, filtered, merged and capped per site."""
    kept = listed.filter(
        url_filter("url", options.includes, options.excludes, options.match_any)
    )
    merged = merge_sitemap_urls(kept)
    return merged if options.max_urls is None else cap_urls(merged, options.max_urls)


def term_rows(pages: DataFrame, options: AnalysisOptions) -> DataFrame:
    """Sparse unit rows of the profile the options name; *pages* has ``processed_text``."""

    def with_stops(profile: D.TfidfProfile) -> D.TfidfProfile:
        return D.TfidfProfile(
            profile.low, profile.high, profile.min_length, profile.sublinear, profile.max_df,
            options.stop_words,
        )

    texts = pages.select(
        "site_id",
        "url",
        process_url_path("url").alias("path_text"),
        F.coalesce("processed_text", F.lit("")).alias("content_text"),
    )
    # read once for every part and count
    texts = stored(texts, "texts")
    if options.use_content and options.use_paths:
        return D.blended_vectors(texts, options.url_weight, with_stops(D.BLENDED), numbers=True)
    if options.use_content:
        return D.term_vectors(texts, with_stops(D.CONTENT_ONLY), "content_text", numbers=True)
    return D.term_vectors(texts, with_stops(D.URL_ONLY), "path_text", numbers=True)


def text_analysis(
    pages: DataFrame, sources: DataFrame, options: AnalysisOptions = AnalysisOptions()
) -> tuple[DataFrame, DataFrame]:
    """(scored pages, scored sites) of pages with ``site_id, url, processed_text``."""
    terms = term_rows(pages, options)
    # pages without any term still have a place in the result
    vectors = pages.select("site_id", "url").join(terms, ["site_id", "url"], "left").select(
        "site_id", "url", F.coalesce("terms", F.array().cast(terms.schema["terms"].dataType)).alias("terms")
    )
    # the layout reads the rows many times, and each time would weigh all terms again
    layout = term_map(
        stored(vectors, "vectors"), method="tsne", perplexity=options.perplexity, rounds=options.rounds, lone_pages=True
    )
    points = coordinates(layout).drop("id")
    scored = S.with_previews(S.page_scores(points), pages, sources)
    return scored, S.planar_site_scores(points, options.k1, options.k2)


def vector_analysis(
    vectors: DataFrame, dimensions: int, max_distance: float = P.CANNIBAL_DISTANCE
) -> tuple[DataFrame, DataFrame]:
    """(scored sites, similar pairs) of stored page vectors."""
    usable = P.usable_vectors(vectors, dimensions)
    return S.vector_site_scores(usable, dimensions), P.cannibalization(
        usable, dimensions, max_distance
    )
