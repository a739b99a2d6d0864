"""Fixed cases of URL, text, date and search functions."""

import pytest
from pyspark.sql import functions as F

from jobweir.functions import dates, match, remote, text as t, urls

STRICT = [
    ("https://boards.greenhouse.io/parity/jobs/4567", ("greenhouse", "parity", "4567")),
    ("https://jobs.ashbyhq.com/parity/abc-def", ("ashbyhq", "parity", "abc-def")),
    ("https://jobs.lever.co/leverdemo/uuid", ("lever", "leverdemo", "uuid")),
    ("https://apply.workable.com/circle/j/ABC123", ("workable", "circle", "ABC123")),
    ("https://acme.workable.com/", ("workable", "acme", None)),
    ("https://example.com/careers", None),
    ("https://www.bamboohr.com/careers/engineering-it-team", None),
    ("https://developers.bamboohr.com/jobs/anything", None),
    ("https://sololearn.bamboohr.com/about", None),
    ("https://sololearn.bamboohr.com/jobs/view.php", ("bamboohr", "sololearn", None)),
    ("https://www.recruitee.com/features", None),
    ("https://exeon.recruitee.com/o/senior-backend-developer", ("recruitee", "exeon", "senior-backend-developer")),
    (
        "https://nvidia.wd5.myworkdayjobs.com/en-US/NVIDIAExternalCareerSite/job/Israel-Yokneam/Engineer_JR2016630",
        ("workday", "nvidia/wd5/NVIDIAExternalCareerSite", "Engineer_JR2016630"),
    ),
    (
        "https://salesforce.wd1.myworkdayjobs.com/External_Career_Site/job/CA-San-Francisco/Eng_JR0987",
        ("workday", "salesforce/wd1/External_Career_Site", "Eng_JR0987"),
    ),
    ("https://nvidia.wd5.myworkdayjobs.com/", None),
    # one host name for two companies: paths keep their case, hosts do not
    ("https://jobs.lever.co/Acme/x", ("lever", "Acme", "x")),
    ("https://ACME.breezy.hr/p/1", ("breezy", "acme", "1")),
    ("https://www.workable.com/x", ("workable", "www", None)),
]
OTHER = [
    (
        "https://jobs.solana.com/companies/ondo-finance/jobs/81464556-x",
        ("other", "jobs.solana.com", "companies/ondo-finance/jobs/81464556-x"),
    ),
    ("mailto:hr@acme.com", None),
    ("https://network.bondex.app/auth/login?signup=web3.career&utm_source=web3.career", None),
    (None, None),
]


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("make,cases", [(urls.classify, STRICT), (urls.classify_or_other, OTHER)])
def test_classify(spark, make, cases):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string")
    got = {r.i: tuple(r.r) if r.r else None for r in df.select("i", make(F.col("u")).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_locale_and_composite(spark):
    for x, want in (("en", True), ("en-US", True), ("fr_FR", True), ("External", False), ("wd5", False)):
        assert one(spark, x, urls.is_locale) is want
    got = one(spark, "nvidia/wd5/NVIDIAExternalCareerSite", urls.composite)
    assert tuple(got) == ("nvidia", "wd5", "NVIDIAExternalCareerSite")
    for x in ("nvidia/foo/Site", "nvidia/wd5", ""):
        assert one(spark, x, urls.composite) is None


def test_texts(spark):
    assert one(spark, "<p>Hello&nbsp;&amp; world</p>", t.strip_tags) == "Hello & world"
    assert one(spark, "&lt;p&gt;a&lt;/p&gt;&amp;lt;b<!-- x --> c", t.html_to_text) == "a c"  # as a page reads: a tag called b<!--
    assert one(spark, "Acme | SWE | Remote", t.company_hint) == "Acme"
    assert one(spark, "x" * 81, t.company_hint) is None
    assert tuple(one(spark, "Just a role", t.split_at)) == ("Just a role", None)
    assert tuple(one(spark, "A at B at C", t.split_at)) == ("A at B", "C")
    assert one(spark, 'site:jobs.ashbyhq.com "Remote"', t.site_includes) == ["jobs.ashbyhq.com"]
    assert one(spark, "foo site:a.com bar site:b.com baz", t.site_includes) == ["a.com", "b.com"]
    assert one(spark, "-site:www.foo.com remote", t.site_includes) == []
    assert one(spark, "site:bamboohr.com -site:www.bamboohr.com remote", t.without_sites) == "remote"
    assert one(spark, "site:a.com", t.keyword_or_default) == "remote jobs"
    assert one(spark, '<a href="https:&#x2F;&#x2F;x.io">', t.hrefs) == ["https://x.io"]
    assert one(spark, 10**18, t.millis_text, "long") is None
    assert one(spark, 1700000000123, t.millis_text, "long") == "2023-11-14T22:13:20.123+00:00"


def test_remote_words(spark):
    for x, want in (("Anywhere", True), ("USA Remote", True), ("Worldwide", True), ("Berlin, Germany", False)):
        assert one(spark, x, lambda c: remote.from_location_or_tags(c, F.lit(None).cast("string"))) is want


def test_ages(spark):
    now = F.lit(1_735_689_600)
    for x, want in (
        (None, "?"), ("2024-12-31T00:00:00Z", "1d"), ("2024-12-31T00:00:00+02:00", "1d"), ("2026-01-01T00:00:00Z", "0d"),
        ("2024-12-30 00:00:00 UTC", "2d"), ("Posted Today", "0d"), ("posted yesterday", "posted yesterday"), ("Yesterday", "1d"),
        ("Posted 1 Day Ago", "1d"), ("Posted 30+ Days Ago", ">30d"), ("2024-01-01", "2024-01-01"), ("Jun 02, 2026", "Jun 02, 2026"),
    ):
        assert one(spark, x, lambda c: dates.age_text(c, now)) == want, x
    for ms, want in ((423, "423ms"), (47_000, "47s"), (94_000, "1min 34s"), (3_923_000, "1h 5min 23s"), (184_320_000, "2d 3h 12min")):
        assert one(spark, ms, dates.duration_text, "long") == want


def test_search(spark):
    df = match.with_tokens(
        spark.createDataFrame(
            [(1, "C++ dev", None, "Rust.", "a b c"), (2, "Trusted", "Zürich", None, "b a"), (3, None, None, None, None)],
            "id int, title string, location string, department string, description string",
        )
    )

    def ids(p):
        return sorted(r.id for r in df.where(p).collect())

    assert ids(match.term("c++")) == [1] and ids(match.term("rust")) == [] and ids(match.term("rust.")) == [1]
    assert ids(match.term("zurich")) == [2] and ids(match.prefix("trust")) == [2]
    assert ids(match.phrase(["a", "b"])) == [1] and ids(match.near("b", "a", 0)) == [1, 2]
    assert ids(match.near("a", "c", 0)) == [] and ids(match.near("a", "c", 1)) == [1]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Don&rsquo;t &#8211; caf&eacute; &#x20ac;", "Don\u2019t \u2013 caf\u00e9 \u20ac"),
        ("&amp;lt; &lt; &#38;gt;", "&lt; < &gt;"),
        ("&nosuch; &#0; &#xD800; &#99999999; & &;", "&nosuch; \ufffd \ufffd \ufffd & &;"),
        ("&#128512;", "\U0001f600"), ("plain", "plain"), ("", ""), (None, None),
    ],
)
def test_unescape(spark, text, want):
    assert one(spark, text, t.unescape) == want


def test_markup_and_entities_as_a_page_reads(spark):
    import html

    cases = {
        "it&#146;s 5&#150;6": "it’s 5–6",
        '<a title="x > y">go</a>': "go",
        "<b>\"q\"</b> <i>'s'</i>": "\"q\" 's'",
        "a < b, c > d <3": "a < b, c > d <3",
        '<a title="x>go</a> rest': "go rest",
        "<img alt='>' src=\"a>b\">\"in\"": '"in"',
        "<p>open <b": "open",
        "<a " + 'x="1>" ' * 20_000 + ">long</a>": "long",
    }
    texts = list(cases) + ["&eacute &copy &notit; &notin; &ampx &#0; &#x110000; &#99999999999; &; &#; &nosuch; &amp;amp;", "&Aacute&lt=&hearts"]
    rows = spark.createDataFrame([(x,) for x in texts], "h string").select(
        "h", t.html_to_text(F.col("h")).alias("t"), t.unescape(F.col("h")).alias("u"), t.unescape(F.col("h"), True).alias("a")
    )
    for r in rows.collect():
        assert r.t == cases.get(r.h, r.t) and r.u == html.unescape(r.h)
    assert rows.collect()[-1].a == "Á&lt=&hearts"
    assert spark.createDataFrame([("a &copy b",)], "h string").select(t.unescape(F.col("h"), True)).first()[0] == "a © b"


def test_names_that_need_their_semicolon(spark):
    strict = lambda c: t.html_to_text(c, legacy_names=False)
    assert one(spark, "<title>x&amp</title>a&amp;copy;b &copy &#169 &amp;#169;", strict) == "x&amp a©b &copy &#169 ©"
    assert one(spark, "<title>x&amp</title>y", t.html_to_text) == "x& y"


def test_years_of_five_digits(spark):
    assert one(spark, 1234567891 * 1199999, t.millis_text, "long") == "48916-03-28T23:23:52.109+00:00"
    assert one(spark, 253402300799999, t.millis_text, "long") == "9999-12-31T23:59:59.999+00:00"
    assert one(spark, 253402300800000, t.millis_text, "long") == "10000-01-01T00:00:00+00:00"
