"""SQL twins of the registered queries, for an independent engine over the same tables."""

from __future__ import annotations

from sitegauge.functions.text import CONTENT_STOP_WORDS, english_stop_words
from sitegauge.plans.inputs import URL_SHAPES

ORACLES: dict[str, str] = {}

_SP = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_ENGLISH = ", ".join("'" + w.replace("'", "''") + "'" for w in english_stop_words())
_STOPS = ", ".join(f"'{w}'" for w in CONTENT_STOP_WORDS)
_SHAPES = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(URL_SHAPES))


def _path(url: str) -> str:
    bare = rf"regexp_extract({url}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
    return rf"regexp_replace({bare}, ';[^/]*$', '')"


def _host(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"


def _words_of_path(url: str) -> str:
    bare = f"regexp_replace({_path(url)}, '^/+|/+$', '', 'g')"
    return (
        f"lower(regexp_replace(translate({bare}, '-_/+', '    '), "
        r"'\.(html|htm|php|aspx|jsp|asp)$', ''))"
    )


def _type(url: str) -> str:
    p = f"lower({_path(url)})"
    tests = [
        ("Home", f"{p} IN ('', '/', '/index.html', '/index.php', '/index.asp')"),
        ("Blog", rf"regexp_matches({p}, '/(blog|article|post|news)(/|$)') OR regexp_matches({p}, '/\d{{4}}/\d{{2}}(/\d{{2}})?(/|$)')"),
        ("Product", rf"regexp_matches({p}, '/(product|item|sku|shop)(/|$)') OR regexp_matches({p}, '/p/[\p{{L}}\p{{N}}_]')"),
        ("Category", f"regexp_matches({p}, '/(category|cat|collection|department|section)(/|$)')"),
        ("Info", f"regexp_matches({p}, '/(about|company|team|history|mission|faq|help|support)(/|$)')"),
        ("Contact", f"regexp_matches({p}, '/(contact|reach-us|get-in-touch)(/|$)')"),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for n, t in tests) + " ELSE 'Other' END"


def _depth(url: str) -> str:
    p = _path(url)
    return (
        f"CAST(len(list_filter(string_split({p}, '/'), lambda s: s <> '')) "
        f"- CASE WHEN contains(string_split({p}, '/')[-1], '.') THEN 1 ELSE 0 END AS INTEGER)"
    )


def _clean(text: str) -> str:
    collapsed = f"regexp_replace({text}, '{_SP}+', ' ', 'g')"
    no_urls = f"regexp_replace({collapsed}, 'https?://[^ ]+', '', 'g')"
    return f"trim(regexp_replace({no_urls}, '[^ ]+@[^ ]+', '', 'g'), ' ')"


def _processed(text: str) -> str:
    return (
        f"array_to_string(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]{{2,}}'), "
        f"lambda w: w NOT IN ({_STOPS})), ' ')"
    )


def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SP}+'), lambda w: w <> '')"


def _preview(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN substr({text}, 1, {n}) || '...' ELSE {text} END"


_CATALOG = f"""url_catalog AS (
  SELECT 'site' || (o_custkey % 20) AS site_id, o_orderkey AS order_key,
    'https://site' || (o_custkey % 20) || '.example.com/sitemap-' || lower(substr(o_orderpriority, 1, 1)) || '.xml' AS sitemap,
    'https://site' || (o_custkey % 20) || '.example.com'
      || replace(CASE o_orderkey % {len(URL_SHAPES)} {_SHAPES} END, 'N', CAST(o_orderkey AS VARCHAR)) AS url
  FROM orders)"""

_PAGES = rf"""site_pages AS (
  SELECT {_host('url')} AS site_id, url, page_id, html,
    'https://' || {_host('url')} || '/sitemap-' || regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) || '.xml' AS source_sitemap
  FROM pages)"""

_TEXT = rf"""{_PAGES}, articles AS (
  SELECT site_id, url, page_id, source_sitemap,
    replace(replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&') AS body
  FROM site_pages), raws AS (
  SELECT site_id, url, page_id, source_sitemap, {_clean('body')} AS raw_text FROM articles), page_text AS (
  SELECT site_id, url, page_id, source_sitemap, raw_text, {_processed('raw_text')} AS processed_text FROM raws)"""

_VECTORS = """vectors AS (
  SELECT CAST(label AS VARCHAR) AS site_id, 'https://example.com/v/' || vec_id AS url,
    CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""

_POINTS = f"""{_VECTORS}, points AS (
  SELECT site_id, url, embedding[1] AS x, embedding[2] AS y FROM vectors)"""

_PAGE_POINTS = f"""{_PAGES}, points AS (
  SELECT site_id, url, length(html) / 1000.0::DOUBLE AS x, page_id / 100.0::DOUBLE AS y FROM site_pages)"""

_PLANAR = """centers AS (
  SELECT site_id, avg(x) AS centroid_x, avg(y) AS centroid_y FROM points GROUP BY site_id), distances AS (
  SELECT p.site_id, p.url, p.x, p.y, sqrt((x - centroid_x) * (x - centroid_x) + (y - centroid_y) * (y - centroid_y)) AS d
  FROM points p JOIN centers USING (site_id))"""

_PLANE_PAIRS = """pairs AS (
  SELECT a.site_id, a.url AS url1, b.url AS url2,
    sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM points a JOIN points b ON a.site_id = b.site_id AND a.url < b.url)"""

_COSINE_PAIRS = """pairs AS (
  SELECT a.site_id, a.url AS url1, b.url AS url2,
    greatest(0.0, least(2.0, 1 - list_cosine_similarity(a.embedding, b.embedding))) AS d
  FROM vectors a JOIN vectors b ON a.site_id = b.site_id AND a.url < b.url)"""

_CENTROID = """components AS (
  SELECT site_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS axis FROM vectors), means AS (
  SELECT site_id, axis, avg(v) AS m FROM components GROUP BY ALL), lengths AS (
  SELECT site_id, sqrt(sum(m * m)) AS n FROM means GROUP BY ALL), centroids AS (
  SELECT site_id, axis, m / n AS value FROM means JOIN lengths USING (site_id)), middles AS (
  SELECT site_id, list(value ORDER BY axis) AS centroid FROM centroids GROUP BY ALL), distances AS (
  SELECT v.site_id, v.url, 1 - list_cosine_similarity(v.embedding, m.centroid) AS d
  FROM vectors v JOIN middles m USING (site_id))"""

_LOG = """status_log AS (
  SELECT 'project ' || (user_id % 10) AS project, 'u' || (event_id % 500) AS url, ts,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
      WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' END AS status,
    CASE WHEN event_type = 'error' THEN props END AS error_message
  FROM events), latest AS (
  SELECT project, url, status, error_message FROM status_log
  QUALIFY row_number() OVER (PARTITION BY project, url ORDER BY ts DESC, status DESC) = 1)"""

_STORE = f"""{_VECTORS}, store AS (
  SELECT site_id AS project, sha256(url) AS point_id, url, embedding,
    CASE WHEN CAST(site_id AS INTEGER) < 5 THEN 'second' ELSE 'first' END AS content_md FROM vectors)"""


def _focus(k1: float, ratio: str = "mean_d / (max_d + 1e-9)") -> str:
    return f"CASE WHEN max_d < 1e-9 THEN 100.0 ELSE 100 * pow(1 - least(1.0, greatest(0.0, {ratio})), {k1 / 5}) END"


def _radius(k2: float, flat: str = "0.0") -> str:
    return f"CASE WHEN diameter < 1e-9 THEN {flat} ELSE 100 * (1 - exp(-(max_d / (diameter + 1e-9)) * {k2 / 5})) END"


def _scores(k1: float, k2: float) -> str:
    return f"""spread AS (SELECT site_id, count(*) AS total, avg(d) AS mean_d, max(d) AS max_d FROM distances GROUP BY site_id),
wide AS (SELECT site_id, max(d) AS diameter FROM pairs GROUP BY site_id), scored AS (
  SELECT site_id, total, mean_d, max_d, coalesce(diameter, 0.0) AS diameter FROM spread LEFT JOIN wide USING (site_id)),
site_scores AS (SELECT site_id, total, mean_d, max_d, diameter, {_focus(k1)} AS focus, {_radius(k2)} AS radius FROM scored)"""


_SCORE_COLUMNS = """site_id, total, round(mean_d, 6) AS mean_distance, round(max_d, 6) AS max_distance,
round(diameter, 6) AS diameter, round(focus, 6) AS focus_score, round(radius, 6) AS radius_score"""

# --- sources and sinks ---
ORACLES["a1_read_url_list"] = """SELECT DISTINCT 'demo' AS project, url, false AS rejected FROM pages
UNION ALL SELECT 'demo', 'url', true"""

_MAPS = rf"""{_PAGES}, named AS (
  SELECT site_id AS domain, page_id, url, CAST(page_id // 50 AS BIGINT) AS chunk,
    regexp_replace(source_sitemap, '\.xml$', '-') AS base FROM site_pages), listed AS (
  SELECT domain, page_id, url, base || chunk || CASE WHEN chunk % 2 = 1 THEN '.xml.gz' ELSE '.xml' END AS sitemap,
    base || 'i' || (chunk // 20) || '.xml' AS idx FROM named)"""
ORACLES["a2_robots_sitemaps"] = f"""WITH {_MAPS}
SELECT DISTINCT domain, idx AS sitemap FROM listed WHERE length(domain) % 2 = 0
UNION ALL SELECT DISTINCT domain, 'http://' || domain || '/old.xml' FROM listed WHERE length(domain) % 2 = 1 AND length(domain) % 3 = 0"""
ORACLES["a3_candidate_sitemaps"] = f"""WITH {_MAPS}
SELECT DISTINCT domain, 'https://' || domain || '/sitemap.xml' AS sitemap FROM listed WHERE length(domain) % 2 = 1 AND length(domain) % 3 <> 0"""
ORACLES["a4_expand_sitemap_index"] = f"""WITH {_MAPS}
SELECT DISTINCT domain, sitemap FROM listed WHERE length(domain) % 2 = 0
UNION ALL SELECT DISTINCT domain, 'https://' || domain || '/sitemap.xml' FROM listed WHERE length(domain) % 2 = 1 AND length(domain) % 3 <> 0"""
ORACLES["a5_scan_sitemaps"] = f"""WITH {_MAPS}
SELECT domain, sitemap, CAST(row_number() OVER (PARTITION BY sitemap ORDER BY page_id) - 1 AS INTEGER) AS position, url FROM listed"""
ORACLES["a5_scan_sitemap_files"] = "SELECT url FROM pages"
ORACLES["a6_scan_project"] = f"WITH {_STORE} SELECT project, point_id, url, CAST(len(embedding) AS INTEGER) AS dimensions FROM store"
ORACLES["a7_list_projects"] = f"WITH {_STORE} SELECT DISTINCT project FROM store"
ORACLES["a8_saved_analysis"] = f"""WITH {_POINTS}, {_PLANAR}
SELECT site_id, url, {_type('url')} AS page_type, round(d, 6) AS distance, 7.0::DOUBLE AS focus_k,
  3::INTEGER AS include_slots, 100::INTEGER AS max_urls FROM distances"""
ORACLES["a9_export_content"] = f"""WITH {_TEXT}, points AS (
  SELECT site_id, url, length(html) / 1000.0::DOUBLE AS x, page_id / 100.0::DOUBLE AS y FROM site_pages), {_PLANAR}
SELECT t.site_id, t.url AS "URL", source_sitemap AS "Source", {_type('t.url')} AS "Type", round(d, 6) AS "Distance",
  CAST(length(raw_text) AS INTEGER) AS raw_len, CAST(length(processed_text) AS INTEGER) AS proc_len,
  substr(raw_text, 1, 500) || '...' AS raw_preview, processed_text
FROM page_text t JOIN distances d ON t.site_id = d.site_id AND t.url = d.url"""
ORACLES["a10_upsert_vectors"] = f"WITH {_STORE} SELECT project, point_id, url, content_md, round(embedding[1], 6) AS v0 FROM store"

# --- scalar functions ---
ORACLES["b1_sanitize_name"] = r"SELECT doc_id, regexp_replace(translate(lower(text), ' -', '__'), '[^\p{L}\p{N}_]', '', 'g') AS name FROM documents"
ORACLES["b2_process_url_path"] = f"WITH {_CATALOG} SELECT order_key, {_words_of_path('url')} AS processed_path FROM url_catalog"
ORACLES["b3_page_type"] = f"WITH {_CATALOG} SELECT order_key, {_type('url')} AS page_type FROM url_catalog"
ORACLES["b4_page_depth"] = f"WITH {_CATALOG} SELECT order_key, {_depth('url')} AS page_depth FROM url_catalog"
ORACLES["b5_url_filter"] = f"""WITH {_CATALOG}, tested AS (SELECT order_key, lower(url) AS u FROM url_catalog), marked AS (
  SELECT order_key, NOT contains(u, 'site3.') AND NOT contains(u, 'page=') AND (contains(u, 'product') OR contains(u, 'blog')) AS any_of,
    contains(u, 'product') AND contains(u, 'p') AS all_of FROM tested)
SELECT order_key, any_of, all_of FROM marked WHERE any_of OR all_of"""
ORACLES["b6_sitemap_term_filter"] = f"""WITH {_CATALOG}
SELECT order_key, url FROM url_catalog WHERE contains(lower(url), 'product') AND NOT contains(lower(url), 'page=2')"""
ORACLES["b7_clean_text"] = f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents"
ORACLES["b8_preprocess_text"] = f"SELECT doc_id, {_processed('text')} AS processed FROM documents"
ORACLES["b9_main_content"] = f"WITH {_TEXT} SELECT site_id, url, raw_text, processed_text FROM page_text"
ORACLES["b10_point_id"] = f"WITH {_CATALOG} SELECT order_key, sha256(url) AS point_id FROM url_catalog"
ORACLES["b11_preview"] = f"""WITH {_TEXT} SELECT url, {_preview('processed_text', 200)} AS content_preview,
  {_preview('raw_text', 500)} AS extraction_preview FROM page_text"""
ORACLES["b12_text_change"] = f"""WITH {_TEXT}, words AS (
  SELECT url, raw_text, processed_text, list_distinct({_split('lower(raw_text)')}) AS r, {_split('processed_text')} AS p FROM page_text)
SELECT url, round(CASE WHEN length(raw_text) > 0 THEN 100 - length(processed_text) / length(raw_text) * 100 ELSE 0.0 END, 6) AS reduction_percent,
  array_to_string(list_sort(list_filter(r, lambda w: NOT list_contains(p, w)))[1:50], ' ') AS removed_words FROM words"""
ORACLES["b13_detail_filter"] = rf"""WITH {_CATALOG}, typed AS (SELECT order_key, url, {_type('url')} AS page_type, sitemap FROM url_catalog)
SELECT order_key, url, page_type, sitemap FROM typed
WHERE (regexp_matches(url, '(?i)PROD|news/story_\d+') AND page_type = 'Product')
  OR (regexp_matches(url, '(?i)site1') AND sitemap = 'https://site1.example.com/sitemap-3.xml')"""
ORACLES["b14_normalize_domain"] = f"SELECT page_id, lower({_host('url')}) AS domain FROM pages"
ORACLES["b15_host"] = f"SELECT page_id, {_host('url')} AS host FROM pages"
_FIRST_LAST = """ranked AS (
  SELECT site_id, url, d, row_number() OVER (PARTITION BY site_id ORDER BY d, url) AS up,
    row_number() OVER (PARTITION BY site_id ORDER BY d DESC, url DESC) AS down FROM distances)"""
ORACLES["b16_numbered_list"] = f"""WITH {_POINTS}, {_PLANAR}, {_FIRST_LAST}, lists AS (
  SELECT site_id, list(url ORDER BY up) FILTER (up <= 7) AS f, list(url ORDER BY up) FILTER (down <= 7) AS l FROM ranked GROUP BY site_id), texts AS (
  SELECT site_id,
    array_to_string(list_transform(f[1:5], lambda u, i: i || '. ' || u || chr(10)), '') || CASE WHEN len(f) > 5 THEN '... and ' || (len(f) - 5) || ' more' || chr(10) ELSE '' END AS a,
    array_to_string(list_transform(l[1:5], lambda u, i: i || '. ' || u || chr(10)), '') || CASE WHEN len(l) > 5 THEN '... and ' || (len(l) - 5) || ' more' || chr(10) ELSE '' END AS b FROM lists)
SELECT site_id, a AS plain_list, rtrim(b, chr(10)) AS trimmed_list, 'N/A' AS empty_list FROM texts"""
ORACLES["b17_choose_content"] = f"""WITH {_TEXT} SELECT page_id, coalesce(
  nullif(CASE WHEN contains(source_sitemap, '-fr') THEN '' ELSE processed_text END, ''),
  nullif(CASE WHEN contains(source_sitemap, '-de') THEN '' ELSE raw_text END, '')) AS content_md FROM page_text"""
ORACLES["b18_inspector_search"] = f"WITH {_CATALOG} SELECT order_key, url FROM url_catalog WHERE contains(lower(url), 'red+hats/1')"
ORACLES["b19_row_outcome"] = f"""WITH {_LOG} SELECT project, url, CASE
  WHEN status = 'failed' AND error_message IS NOT NULL THEN 'failed' WHEN status = 'skipped' THEN 'skipped'
  WHEN status = 'pending' THEN 'failed_reader' WHEN status = 'processing' THEN 'failed_embedding' ELSE 'completed' END AS outcome FROM latest"""

# --- de-duplication, ordering, limits ---
_MERGED = f"""{_CATALOG}, merged AS (
  SELECT site_id, url, max(sitemap) AS source_sitemap, min(sitemap) AS first_sitemap,
    arg_min(order_key, (sitemap, order_key)) AS first_position FROM url_catalog GROUP BY site_id, url)"""
ORACLES["c1_merge_sitemap_urls"] = f"WITH {_MERGED} SELECT site_id, url, source_sitemap, first_sitemap, first_position FROM merged"
ORACLES["c2_cap_urls"] = f"""WITH {_MERGED}, capped AS (
  SELECT site_id, url, CAST(row_number() OVER (PARTITION BY site_id ORDER BY first_sitemap, first_position, url) AS INTEGER) AS seq FROM merged)
SELECT site_id, url, seq FROM capped WHERE seq <= 100"""
ORACLES["c3_skip_processed"] = f"WITH {_LOG} SELECT project, url, status FROM latest WHERE status <> 'completed'"
ORACLES["c4_inspectable_urls"] = f"WITH {_TEXT} SELECT site_id, url FROM page_text WHERE length(raw_text) > 1500 OR contains(processed_text, 'que')"
ORACLES["c5_sort_by_distance"] = f"WITH {_POINTS}, {_PLANAR} SELECT site_id, url, round(d, 6) AS distance FROM distances"
ORACLES["c6_facet_values"] = f"""WITH {_CATALOG} SELECT DISTINCT site_id, 'page_type' AS facet, {_type('url')} AS value FROM url_catalog
UNION ALL SELECT DISTINCT site_id, 'sitemap', sitemap FROM url_catalog"""

# --- TF-IDF ---


def _docs(site: str) -> str:
    return f"docs AS (SELECT {site} AS site_id, 'd/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS url, text FROM documents)"


def _grams(words: str, high: int) -> str:
    parts = [words]
    for n in range(2, high + 1):
        run = " || ' ' || ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(n))
        parts.append(f"list_transform(range(1, len({words}) - {n - 2}), lambda i: {run})")
    joined = parts[0]
    for part in parts[1:]:
        joined = f"list_concat({joined}, {part})"
    return joined


def _tfidf(source: str, text: str, high: int, least: int, sublinear: bool, tag: str = "") -> str:
    tf = "1 + ln(tf)" if sublinear else "tf"
    return rf"""tok{tag} AS (SELECT site_id, url, list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{{least},}}'), lambda t: t NOT IN ({_ENGLISH})) AS w FROM {source}),
gram{tag} AS (SELECT site_id, url, unnest({_grams('w', high)}) AS term FROM tok{tag}),
tf{tag} AS (SELECT site_id, url, term, count(*) AS tf FROM gram{tag} GROUP BY ALL),
n{tag} AS (SELECT site_id, count(*) AS n FROM {source} GROUP BY site_id),
df{tag} AS (SELECT site_id, term, count(*) AS df FROM tf{tag} GROUP BY ALL),
kept{tag} AS (SELECT site_id, term, df, n FROM df{tag} JOIN n{tag} USING (site_id) WHERE df <= 0.95 * n),
w{tag} AS (SELECT site_id, url, term, ({tf}) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf{tag} JOIN kept{tag} USING (site_id, term)),
len{tag} AS (SELECT site_id, url, sqrt(sum(w * w)) AS l FROM w{tag} GROUP BY ALL),
unit{tag} AS (SELECT site_id, url, term, w / l AS w FROM w{tag} JOIN len{tag} USING (site_id, url))"""


_DOC_TFIDF = f"{_docs('lang')}, {_tfidf('docs', 'text', 2, 1, True)}"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
ORACLES["d1_tokens"] = f"""WITH {_docs('lang')} SELECT url,
  array_to_string(list_filter({_WORDS}, lambda w: w NOT IN ({_ENGLISH})), ' ') AS tokens FROM docs"""
ORACLES["d2_ngrams"] = rf"""WITH {_docs('lang')}, t AS (SELECT url, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM docs),
g AS (SELECT url, {_grams('w', 3)} AS g FROM t)
SELECT url, CAST(len(g) AS INTEGER) AS grams, md5(array_to_string(g, '|')) AS digest FROM g"""
ORACLES["d3_term_counts"] = f"WITH {_DOC_TFIDF} SELECT site_id, url, term, tf FROM tf"
ORACLES["d4_document_frequency"] = f"WITH {_DOC_TFIDF} SELECT site_id, term, df FROM kept"
ORACLES["d5_tfidf_weights"] = f"WITH {_DOC_TFIDF} SELECT site_id, url, term, round(w, 6) AS w FROM w"
ORACLES["d6_l2_normalize"] = f"WITH {_DOC_TFIDF} SELECT site_id, url, term, round(w, 6) AS w FROM unit"
ORACLES["d6_url_profile"] = f"""WITH {_CATALOG}, paths AS (SELECT DISTINCT site_id, url, {_words_of_path('url')} AS text FROM url_catalog),
{_tfidf('paths', 'text', 3, 1, True)} SELECT site_id, url, term, round(w, 6) AS w FROM unit"""
ORACLES["d7_vectorize_status"] = f"""WITH {_PAGES}, paths AS (SELECT site_id, url, {_words_of_path('url')} AS text FROM site_pages),
{_tfidf('paths', 'text', 3, 1, True)}, sizes AS (
  SELECT site_id, count(*) AS pages, max(trim(text) <> '') AS has_text FROM paths GROUP BY site_id), usable AS (
  SELECT site_id, count(DISTINCT url) AS vectors FROM unit GROUP BY site_id)
SELECT site_id, pages, coalesce(vectors, 0) AS vectors, CASE WHEN NOT has_text THEN 'empty_corpus'
  WHEN vectors IS NULL AND pages = 1 THEN 'single_page' WHEN vectors IS NULL THEN 'no_terms_left' ELSE 'ok' END AS vectorize_status
FROM sizes LEFT JOIN usable USING (site_id)"""

# --- aggregates ---
ORACLES["f1_centroid_2d"] = f"WITH {_POINTS}, {_PLANAR} SELECT site_id, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y FROM centers"
ORACLES["f2_centroid_nd"] = f"WITH {_VECTORS}, {_CENTROID} SELECT site_id, CAST(axis AS INTEGER) AS axis, round(value, 6) AS value FROM centroids"
ORACLES["f3_distance_euclid"] = f"""WITH {_PAGE_POINTS}, {_PLANAR}
SELECT site_id, url, {_words_of_path('url')} AS processed_path, {_type('url')} AS page_type, {_depth('url')} AS page_depth, x, y,
  round(d, 6) AS distance_from_centroid FROM distances"""
ORACLES["f4_distance_cosine"] = f"WITH {_VECTORS}, {_CENTROID} SELECT site_id, url, round(d, 6) AS distance FROM distances"
ORACLES["f5_f6_planar_scores"] = f"WITH {_POINTS}, {_PLANAR}, {_PLANE_PAIRS}, {_scores(15.0, 2.0)} SELECT {_SCORE_COLUMNS} FROM site_scores"
ORACLES["f7_f8_vector_scores"] = f"WITH {_VECTORS}, {_CENTROID}, {_COSINE_PAIRS}, {_scores(5.0, 5.0)} SELECT {_SCORE_COLUMNS} FROM site_scores"
ORACLES["f9_value_counts"] = f"""WITH {_CATALOG}, v AS (
  SELECT site_id, {_type('url')} AS value, 1 AS kind FROM url_catalog UNION ALL SELECT site_id, sitemap, 2 FROM url_catalog), c AS (
  SELECT site_id, kind, value, count(*) AS pages FROM v GROUP BY ALL)
SELECT site_id, value, pages, round(pages / sum(pages) OVER (PARTITION BY site_id, kind) * 100, 1) AS share FROM c"""


def _bins(bins: int) -> str:
    return f"""bounds AS (SELECT site_id, min(d) AS low, max(d) AS high FROM measured GROUP BY site_id), placed AS (
  SELECT site_id, low, (high - low) / {bins} AS width, CAST(CASE WHEN high > low
    THEN least(floor((d - low) / ((high - low) / {bins})), {bins - 1}) ELSE 0 END AS BIGINT) AS bin
  FROM measured JOIN bounds USING (site_id))"""


ORACLES["f10_histogram"] = f"""WITH {_POINTS}, {_PLANAR}, measured AS (SELECT site_id, d FROM distances), {_bins(30)}
SELECT site_id, bin, count(*) AS pages, round(min(low + bin * width), 6) AS bin_start, round(min(low + (bin + 1) * width), 6) AS bin_end
FROM placed GROUP BY site_id, bin"""
ORACLES["f10_pair_histogram"] = f"""WITH {_POINTS}, {_PLANE_PAIRS}, measured AS (SELECT site_id, d FROM pairs WHERE d > 1e-6), {_bins(50)}
SELECT site_id, CAST(bin AS INTEGER) AS bin, count(*) AS pairs FROM placed GROUP BY site_id, bin"""
ORACLES["f11_extraction_stats"] = f"""WITH {_TEXT} SELECT site_id, round(avg(length(raw_text)), 6) AS mean_length,
  count(*) FILTER (raw_text = '') AS empty_texts FROM page_text GROUP BY site_id"""


def _frequency(keys: str, limit: int) -> str:
    return f"""WITH {_TEXT}, words AS (SELECT site_id, url, unnest({_split('processed_text')}) AS word FROM page_text), counts AS (
  SELECT {keys}, word, count(*) AS frequency FROM words WHERE length(word) > 1 GROUP BY ALL), ranked AS (
  SELECT {keys}, word, frequency, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY frequency DESC, word) AS INTEGER) AS rank FROM counts)
SELECT {keys}, word, frequency, rank FROM ranked WHERE rank <= {limit}"""


ORACLES["f12_word_frequency"] = _frequency("site_id, url", 20)
ORACLES["f12_site_word_frequency"] = _frequency("site_id", 15)
ORACLES["f13_lexical_stats"] = f"""WITH {_TEXT}, words AS (SELECT site_id, url, {_split('processed_text')} AS w FROM page_text), counted AS (
  SELECT site_id, url, CAST(len(w) AS INTEGER) AS word_count, CAST(len(list_distinct(list_filter(w, lambda x: length(x) > 1))) AS INTEGER) AS unique_words FROM words)
SELECT site_id, url, word_count, unique_words, round(CASE WHEN word_count > 0 THEN unique_words / word_count ELSE 0.0 END, 6) AS lexical_diversity FROM counted"""


def _pair_stats(lead: str, pairs: str, rows: str) -> str:
    return f"""WITH {lead}, {pairs}, sizes AS (SELECT site_id, count(*) AS n FROM {rows} GROUP BY site_id), stats AS (
  SELECT site_id, count(url2) AS pairs, min(d) FILTER (d > 1e-6) AS lo, avg(d) FILTER (d > 1e-6) AS mean, max(d) AS hi,
    count(*) FILTER (d <= 1e-6) AS near FROM sizes LEFT JOIN pairs USING (site_id) GROUP BY site_id)
SELECT site_id, pairs, round(lo, 6) AS min_distance, round(mean, 6) AS mean_distance, round(coalesce(hi, 0.0), 6) AS max_distance,
  2 * near + n AS near_zero FROM stats JOIN sizes USING (site_id)"""


ORACLES["f14_pair_distance_stats"] = _pair_stats(_POINTS, _PLANE_PAIRS, "points")
_TOP_COSINE = """best AS (
  SELECT site_id, url1, url2, d, row_number() OVER (PARTITION BY site_id ORDER BY round(1 - d, 9) DESC, url1, url2) AS rank FROM pairs WHERE d < {bound})"""
ORACLES["f15_project_result"] = f"""WITH {_VECTORS}, {_CENTROID}, {_COSINE_PAIRS}, {_scores(5.0, 5.0)}, {_TOP_COSINE.format(bound=0.7)}, listed AS (
  SELECT site_id, string_agg(url1 || ' ' || url2 || ' ' || printf('%.4f', 1 - d), '; ' ORDER BY rank) AS pairs FROM best WHERE rank <= 50 GROUP BY site_id)
SELECT s.site_id, s.total, round(focus, 6) AS focus_score, round(radius, 6) AS radius_score, round(centroid[1], 6) AS centroid_0, coalesce(l.pairs, '') AS pairs
FROM site_scores s JOIN middles m ON s.site_id = m.site_id LEFT JOIN listed l ON s.site_id = l.site_id"""

# --- joins ---
ORACLES["e1_pairwise_euclid"] = f"""WITH {_PAGE_POINTS}, {_PLANE_PAIRS}, measured AS (SELECT site_id, d FROM pairs WHERE d > 1e-6), {_bins(200)}
SELECT site_id, CAST(bin AS INTEGER) AS bin, count(*) AS pairs FROM placed GROUP BY site_id, bin"""
ORACLES["e2_diameter_2d"] = f"WITH {_POINTS}, {_PLANE_PAIRS} SELECT site_id, round(max(d), 6) AS diameter FROM pairs GROUP BY site_id"
ORACLES["e3_pairwise_cosine"] = _pair_stats(_VECTORS, _COSINE_PAIRS, "vectors")
ORACLES["e4_diameter_cosine"] = f"WITH {_VECTORS}, {_COSINE_PAIRS} SELECT site_id, round(max(d), 6) AS diameter FROM pairs GROUP BY site_id"
ORACLES["e4_diameter_cosine_pruned"] = ORACLES["e4_diameter_cosine"]
ORACLES["e5_near_duplicates"] = f"""WITH {_POINTS}, {_PLANE_PAIRS} SELECT site_id, url1, url2, round(d, 6) AS distance,
  {_words_of_path('url1')} AS path1, {_words_of_path('url2')} AS path2 FROM pairs WHERE d > 1e-9 AND d < 0.02"""
ORACLES["e6_cannibalization"] = f"""WITH {_VECTORS}, {_COSINE_PAIRS}, {_TOP_COSINE.format(bound=0.7)}
SELECT site_id, CAST(rank AS INTEGER) AS rank, url1, url2, round(1 - d, 6) AS similarity FROM best WHERE rank <= 50"""


def _sparse_top(units: str, least: float) -> str:
    return f"""dots AS (SELECT a.site_id, a.url AS url1, b.url AS url2, sum(a.w * b.w) AS s
  FROM {units} a JOIN {units} b ON a.site_id = b.site_id AND a.term = b.term AND a.url < b.url GROUP BY ALL), best AS (
  SELECT site_id, url1, url2, s, row_number() OVER (PARTITION BY site_id ORDER BY round(s, 9) DESC, url1, url2) AS rank FROM dots WHERE s > {least})
SELECT site_id, CAST(rank AS INTEGER) AS rank, url1, url2, round(s, 6) AS similarity FROM best WHERE rank <= 50"""


ORACLES["e6_similar_term_pairs"] = f"WITH {_DOC_TFIDF}, {_sparse_top('unit', 0.9)}"
ORACLES["e7_blended_similarity"] = rf"""WITH {_docs('source')}, pages2 AS (
  SELECT site_id, url, text AS content_text, array_to_string(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')[1:3], ' ') AS path_text FROM docs),
{_tfidf('pages2', 'path_text', 2, 2, False, '_u')}, {_tfidf('pages2', 'content_text', 2, 2, False, '_c')}, blend AS (
  SELECT site_id, url, 'u:' || term AS term, w * sqrt(0.3) AS w FROM unit_u
  UNION ALL SELECT site_id, url, 'c:' || term, w * sqrt(0.7) FROM unit_c), {_sparse_top('blend', 0.5)}"""
ORACLES["e8_pair_scope"] = f"""WITH {_PAGE_POINTS}, {_PLANE_PAIRS}, near AS (SELECT site_id, url1, url2 FROM pairs WHERE d > 1e-9 AND d < 1.0)
SELECT n.site_id, url1, url2, a.source_sitemap AS source1, b.source_sitemap AS source2,
  CASE WHEN a.source_sitemap = b.source_sitemap THEN 'same' ELSE 'different' END AS scope
FROM near n JOIN site_pages a ON a.site_id = n.site_id AND a.url = url1 JOIN site_pages b ON b.site_id = n.site_id AND b.url = url2"""
ORACLES["e9_lookups"] = f"""WITH {_TEXT}, points AS (
  SELECT site_id, url, length(html) / 1000.0::DOUBLE AS x, page_id / 100.0::DOUBLE AS y FROM site_pages), {_PLANAR}
SELECT t.site_id, t.url,
  CAST(CASE WHEN length(raw_text) > 1500 THEN length(raw_text) ELSE 3 END AS INTEGER) AS raw_length,
  CAST(CASE WHEN length(raw_text) > 1500 THEN length(processed_text) ELSE 3 END AS INTEGER) AS processed_length,
  CASE WHEN contains(source_sitemap, '-es') THEN 'Unknown' ELSE source_sitemap END AS source_sitemap,
  CASE WHEN {_depth('t.url')} = 2 THEN {_type('t.url')} ELSE 'N/A' END AS page_type,
  CASE WHEN {_depth('t.url')} = 2 THEN round(d, 6) END AS distance
FROM page_text t JOIN distances d ON t.site_id = d.site_id AND t.url = d.url"""
ORACLES["e10_knn"] = f"""WITH {_VECTORS}, {_COSINE_PAIRS}, both_ways AS (
  SELECT site_id, url1 AS url, url2 AS neighbour, d FROM pairs UNION ALL SELECT site_id, url2, url1, d FROM pairs), ranked AS (
  SELECT site_id, url, neighbour, d, row_number() OVER (PARTITION BY site_id, url ORDER BY round(d, 9), neighbour) AS rank FROM both_ways)
SELECT site_id, url, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) AS distance FROM ranked WHERE rank <= 15"""
_TERM_NEIGHBOURS = f"""{_DOC_TFIDF}, met AS (
  SELECT a.site_id, a.url, b.url AS neighbour, 1 - sum(a.w * b.w) AS d FROM unit a JOIN unit b ON a.site_id = b.site_id AND a.term = b.term AND a.url <> b.url GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, url ORDER BY round(d, 9), neighbour) AS rank FROM met)"""
ORACLES["e10_nearest_by_terms"] = f"""WITH {_TERM_NEIGHBOURS}
SELECT site_id, url, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) AS distance FROM ranked WHERE rank <= 15"""
ORACLES["e11_inspector_filter"] = f"""WITH {_MERGED} SELECT site_id, url FROM merged
WHERE {_type('url')} = 'Product' AND source_sitemap = 'https://site7.example.com/sitemap-2.xml'"""

# --- ranks ---
ORACLES["g1_most_focused_divergent"] = f"""WITH {_PAGE_POINTS}, {_PLANAR}, ranked AS (
  SELECT site_id, url, d, row_number() OVER (PARTITION BY site_id ORDER BY d, url) AS up,
    row_number() OVER (PARTITION BY site_id ORDER BY d DESC, url) AS down FROM distances), lists AS (
  SELECT site_id, up AS rank, url, d, 'focused' AS list FROM ranked WHERE up <= 10
  UNION ALL SELECT site_id, down, url, d, 'divergent' FROM ranked WHERE down <= 10)
SELECT l.site_id, CAST(rank AS INTEGER) AS rank, l.url, {_type('l.url')} AS page_type, source_sitemap, round(d, 6) AS distance, list
FROM lists l JOIN site_pages p ON l.site_id = p.site_id AND l.url = p.url"""
ORACLES["g2_brief_lists"] = f"""WITH {_POINTS}, {_PLANAR}, {_FIRST_LAST}
SELECT site_id, string_agg(url, ' ' ORDER BY up) FILTER (up <= 5) AS focused, string_agg(url, ' ' ORDER BY up) FILTER (down <= 5) AS divergent
FROM ranked GROUP BY site_id"""
ORACLES["g3_focus_rank"] = f"""WITH {_POINTS}, {_PLANAR}, ranked AS (
  SELECT site_id, url, row_number() OVER (PARTITION BY site_id ORDER BY d, url) AS position, count(*) OVER (PARTITION BY site_id) AS n FROM distances), percents AS (
  SELECT site_id, url, position, CASE WHEN n > 1 THEN (position - 1) / (n - 1) * 100 ELSE 0.0 END AS p FROM ranked)
SELECT site_id, url, position, round(p, 6) AS focus_rank, CASE WHEN p < 20 THEN 'Highly Focused' WHEN p > 80 THEN 'Highly Divergent' END AS focus_label FROM percents"""
ORACLES["g4_top_pairs"] = f"""WITH {_POINTS}, {_PLANE_PAIRS}, near AS (SELECT * FROM pairs WHERE d > 1e-9 AND d < 0.05), ranked AS (
  SELECT site_id, url1, url2, d, row_number() OVER (PARTITION BY site_id ORDER BY d, url1, url2) AS rank, count(*) OVER (PARTITION BY site_id) AS total_pairs FROM near)
SELECT site_id, CAST(rank AS INTEGER) AS rank, url1, url2, round(d, 6) AS distance, total_pairs FROM ranked WHERE rank <= 20"""

# --- report ---
ORACLES["r1_site_brief"] = f"""WITH {_POINTS}, {_PLANAR}, {_PLANE_PAIRS}, {_scores(5.0, 5.0)}, {_FIRST_LAST}, lists AS (
  SELECT site_id, list(url ORDER BY up) FILTER (up <= 5) AS f, list(url ORDER BY up) FILTER (down <= 5) AS l FROM ranked GROUP BY site_id), kinds AS (
  SELECT site_id, {_type('url')} AS k, count(*) AS c FROM points GROUP BY ALL), kind_lines AS (
  SELECT site_id, string_agg(k || ' ' || c || ' (' || printf('%.1f', c / t * 100) || '%)', chr(10) ORDER BY c DESC, k) AS page_types
  FROM (SELECT site_id, k, c, sum(c) OVER (PARTITION BY site_id) AS t FROM kinds) GROUP BY site_id), cosine AS (
  SELECT a.site_id, a.url AS url1, b.url AS url2, list_cosine_similarity(a.embedding, b.embedding) AS s
  FROM vectors a JOIN vectors b ON a.site_id = b.site_id AND a.url < b.url), near AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(s, 9) DESC, url1, url2) AS rank FROM cosine WHERE s > 0.45), pair_lines AS (
  SELECT site_id, least(count(*), 50) || ' pairs, the closest being' || chr(10) ||
    string_agg(printf('%.2f', s) || ' ' || url1 || ' ~ ' || url2, chr(10) ORDER BY rank) FILTER (rank <= 3) AS similar_pairs
  FROM near GROUP BY site_id), parts AS (
  SELECT s.site_id, s.total, printf('%.2f', focus) AS focus_score, printf('%.2f', radius) AS radius_score,
    array_to_string(list_transform(f, lambda u, i: i || '. ' || u), chr(10)) AS focused_pages,
    array_to_string(list_transform(l, lambda u, i: i || '. ' || u), chr(10)) AS divergent_pages, page_types,
    coalesce(similar_pairs, 'none found') AS similar_pairs
  FROM site_scores s JOIN lists USING (site_id) JOIN kind_lines USING (site_id) LEFT JOIN pair_lines USING (site_id))
SELECT *, 'Pages: ' || total || chr(10) || 'Focus score: ' || focus_score || ' / 100' || chr(10) || 'Radius score: ' || radius_score || ' / 100' || chr(10)
  || 'Closest to the core theme:' || chr(10) || focused_pages || chr(10) || 'Furthest from the core theme:' || chr(10) || divergent_pages || chr(10)
  || 'Page types:' || chr(10) || page_types || chr(10) || 'Similar pages:' || chr(10) || similar_pairs AS brief FROM parts"""

ORACLES["m1_pca_energy"] = f"""WITH {_VECTORS}, parts AS (
  SELECT site_id, url, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM vectors), means AS (
  SELECT site_id, i, avg(v) AS m FROM parts GROUP BY ALL)
SELECT site_id, url, round(sum((v - m) * (v - m)), 6) AS energy FROM parts JOIN means USING (site_id, i) GROUP BY ALL"""

_TERM_PAGES = f"{_DOC_TFIDF}, sized AS (SELECT site_id, count(DISTINCT url) AS pages FROM unit GROUP BY site_id)"
ORACLES["m1_sparse_pca"] = f"""WITH {_TERM_PAGES}
SELECT site_id, CAST(axis AS INTEGER) AS axis, pages, true AS centred FROM sized, range(10) t(axis)"""
# every site of more than one page, all pages of it; the layout may not lose neighbours that its start had
_MAPPED = f"WITH {_VECTORS}, sized AS (SELECT site_id, count(*) AS pages FROM vectors GROUP BY site_id) SELECT site_id, pages, true AS keeps_at_least_pca FROM sized WHERE pages > 1"
ORACLES["m2_neighbour_map_umap"] = _MAPPED
ORACLES["m2_neighbour_map_tsne"] = _MAPPED
ORACLES["m2_term_map"] = f"""WITH {_TERM_NEIGHBOURS}
SELECT site_id, count(DISTINCT url) AS pages, true AS keeps_at_least_pca FROM met GROUP BY site_id"""
ORACLES["m3_coordinates"] = f"""WITH {_VECTORS}, sized AS (SELECT *, count(*) OVER (PARTITION BY site_id) AS pages FROM vectors)
SELECT site_id, url, sha256(url) AS id, true AS finite FROM sized WHERE pages > 1"""

# --- streaming ---
_ROLLUP = f"""WITH {_LOG}, counts AS (
  SELECT project, count(*) AS total, count(*) FILTER (status IN ('completed', 'skipped')) AS processed, count(*) FILTER (status = 'failed') AS failed
  FROM latest GROUP BY project)
SELECT project, total, processed, greatest(total - processed - failed, 0) AS pending, failed FROM counts"""
ORACLES["t1_ingest_stream"] = f"WITH {_STORE} SELECT project, point_id, url, 'text' AS content_md FROM store"
ORACLES["t2_status_rollup"] = _ROLLUP
ORACLES["t2_status_stream"] = _ROLLUP
ORACLES["t3_emit_on_change"] = _ROLLUP
ORACLES["t4_completion_event"] = f"""WITH {_LOG} SELECT project, count(*) AS total, count(*) AS processed, CAST(0 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS failed
FROM latest GROUP BY project"""
