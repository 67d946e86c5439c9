import pytest
from pyspark.sql import functions as F

from sitegauge.functions import text as T
from sitegauge.functions import urls as U
from sitegauge.sources.html import main_text

URLS = [
    ("https://garden.test/", "", "Home", 0),
    ("https://garden.test", "", "Home", 0),
    ("https://garden.test/index.html", "index", "Home", 0),
    ("https://garden.test/garden/cat/spade9.html", "garden cat spade9", "Category", 2),
    ("https://garden.test/garden/category/", "garden category", "Category", 2),
    ("https://garden.test/blog/2019/11/first-frost", "blog 2019 11 first frost", "Blog", 4),
    ("https://garden.test/2021/12/24/x", "2021 12 24 x", "Blog", 4),
    ("https://garden.test/our-team", "our team", "Other", 1),
    ("https://garden.test/about", "about", "Info", 1),
    ("https://garden.test/contact", "contact", "Contact", 1),
    ("https://garden.test/contact.html", "contact", "Other", 0),
    ("https://garden.test/p/AB_12", "p ab 12", "Product", 2),
    ("https://garden.test/Shop/Red+Hat.HTML?x=1#y", "shop red hat.html", "Product", 1),
    ("https://garden.test/docs/v1.2", "docs v1.2", "Other", 1),
    ("https://garden.test/a b/c;v=1", "a b c", "Other", 2),
]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(rows.select("i", expression).collect())]


def test_url_functions(spark):
    urls = [u[0] for u in URLS]
    assert column(spark, urls, U.process_url_path("v")) == [u[1] for u in URLS]
    assert column(spark, urls, U.page_type("v")) == [u[2] for u in URLS]
    assert column(spark, urls, U.page_depth("v")) == [u[3] for u in URLS]


def test_names_and_domains(spark):
    assert column(spark, ["My Test Project-123", "!!!"], U.sanitize_name("v")) == ["my_test_project_123", ""]
    assert column(spark, [" HTTPS://Example.com// "], U.normalize_domain("v")) == ["example.com"]


def test_text_cleaning(spark):
    mail = "  Hello\n\n\nworld  see https://a.b/c?d now or mail me@x.io today "
    assert column(spark, [mail], T.clean_text("v")) == ["Hello world see  now or mail  today"]
    inputs = [
        "These are the opening hours of hall 7. The pool is closed on holidays.",
        "Café déjà-vu: the 2nd U.S. test!",
        "A an the",
    ]
    expected = ["these are opening hours of hall pool is closed holidays", "caf vu 2nd test", ""]
    once = column(spark, inputs, T.preprocess_text("v"))
    assert once == expected
    assert column(spark, once, T.preprocess_text("v")) == expected


@pytest.mark.parametrize("words,expected", [("", []), ("a", ["a"]), ("a b c", ["a", "b", "c", "a b", "b c", "a b c"])])
def test_ngrams(spark, words, expected):
    assert column(spark, [words], T.ngrams(T.tokens("v"), 1, 3)) == [expected]


def test_numbered_list(spark):
    row = spark.sql("SELECT array('a','b','c') AS u, array() AS e").select(
        U.numbered_list("u", 2).alias("long"),
        U.numbered_list("u", 2, empty="N/A").alias("trimmed"),
        U.numbered_list(F.col("e").cast("array<string>"), 2, empty="N/A").alias("none"),
    ).first()
    assert row.long == "1. a\n2. b\n... and 1 more\n"
    assert row.trimmed == "1. a\n2. b\n... and 1 more"
    assert row.none == "N/A"


def test_url_filter_modes(spark):
    values = ["x/Alpha/beta", "x/alpha", "x/beta", "x/other"]
    assert column(spark, values, U.url_filter("v", ["ALPHA", "beta"], [], True)) == [True, True, True, False]
    assert column(spark, values, U.url_filter("v", ["ALPHA", "beta"], [], False)) == [True, False, False, False]
    assert column(spark, values, U.url_filter("v", [], ["alpha"])) == [False, False, True, True]


def test_main_text_branches():
    noise = "<nav>menu</nav><script>x()</script><footer>foot</footer>"
    page = "<html><head><title>t</title></head><body>{}</body></html>"
    cases = [
        (f"{noise}<main>m</main><article> a <b>b</b>{noise}</article>", "a b"),
        (f"{noise}<main>m <i>n</i></main>", "m n"),
        (f'{noise}<div class="post">c</div><div id="Main-Post">i</div>', "i"),
        (f'{noise}<div class="x article-body">c &amp; d</div>', "c & d"),
        (f"{noise}<p>plain", "plain"),
        ("", ""),
    ]
    for body, expected in cases:
        assert main_text(page.format(body)) == expected
    assert main_text("") == "" and main_text(None) == ""
