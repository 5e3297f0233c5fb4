import posixpath
import random
import re
from urllib.parse import urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from sitegrain.functions import segments, urls


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, u string")
    return [r[0] for r in df.select("i", expression(F.col("u")).alias("x")).orderBy("i").select("x").collect()]


CANONICAL = [
    ("HTTPS://Example.COM/Path", "https://HTTPS//Example.COM/Path".lower().replace("path", "Path").replace("example.com", "Example.COM")),
    ("https://Example.COM/Path", "https://example.com/Path"),
    ("http://example.com:80/a", "http://example.com/a"),
    ("https://example.com:443/a", "https://example.com/a"),
    ("https://example.com/a#frag", "https://example.com/a"),
    ("https://example.com/a/", "https://example.com/a"),
    ("https://example.com/", "https://example.com/"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com/a/./b/../c//d", "https://example.com/a/c/d"),
    ("https://example.com/a?utm_source=x&b=2&a=1&REF=q", "https://example.com/a?a=1&b=2"),
    ("https://example.com/a?b=1&b=2", "https://example.com/a?b=1"),
    ("https://example.com/a?k", "https://example.com/a?k="),
    ("https://example.com/a?q=a+b%20c*~", "https://example.com/a?q=a+b+c%2A~"),
    ("https://example.com/a?q=100%", "https://example.com/a?q=100%25"),
    ("https://example.com/a;p=1", "https://example.com/a"),
    ("example.com/x", "https://example.com/x"),
    ("https://example.com/../../a", "https://example.com/a"),
    ("", ""),
    (None, None),
]


def test_canonical(spark):
    assert column(spark, [u for u, _ in CANONICAL[1:]], urls.canonical) == [w for _, w in CANONICAL[1:]]


def test_canonical_is_idempotent(spark):
    draw = random.Random(5)
    made = ["https://h.com" + "".join(draw.choice(["/", "a", "B", "..", ".", "-", "?x=1", "&y=%41", "#f", ";p", "é"]) for _ in range(draw.randint(0, 9))) for _ in range(300)]
    once = column(spark, made, urls.canonical)
    assert column(spark, once, urls.canonical) == once


def test_frontier_key(spark):
    def key(u):
        p = urlparse(u)
        return f"{p.scheme.lower()}://{p.netloc.lower()}{posixpath.normpath(p.path) if p.path else ''}" + (f"?{p.query}" if p.query else "")

    draw = random.Random(6)
    made = ["https://H.com" + "".join(draw.choice(["/", "a", "b", "..", ".", "?x=1", "#f", "//"]) for _ in range(draw.randint(0, 8))) for _ in range(400)]
    made = [u for u in made if re.match(r"https://H\.com([/?#]|$)", u)]
    assert column(spark, made, urls.frontier_key) == [key(u) for u in made]


def test_resolve_is_urljoin_with_repeats_collapsed(spark):
    def want(base, href):
        p = urlparse(urljoin(base, href))
        return urlunparse(p._replace(path=re.sub(r"(/[^/]+)\1+(?=/|$)", r"\1", p.path)))

    draw = random.Random(7)
    bases = ["https://h.com/a/b.html", "https://h.com/a/b/", "https://h.com", "https://h.com/x?y=1#z"]
    hrefs = ["c.html", "/c", "../c", "./c", "?q=1", "//o.com/p", "https://o.com/a/a/b", "b/", "../../../z", ".", "..", "a/b/b/b", "x/../y", "/", "c?d#e", "mailto:x"]
    hrefs += ["".join(draw.choice(["/", "..", ".", "a", "b"]) + "/" for _ in range(draw.randint(1, 6))) + "p" for _ in range(100)]
    hrefs = [h for h in hrefs if not h.startswith("//") or h == "//o.com/p"]
    pairs = [(i, b, h) for i, (b, h) in enumerate((b, h) for b in bases for h in hrefs)]
    df = spark.createDataFrame(pairs, "i int, b string, h string").select("i", urls.resolve(F.col("b"), F.col("h")).alias("x")).orderBy("i")
    got = [r.x for r in df.collect()]
    wrong = [(p, g, want(p[1], p[2])) for p, g in zip(pairs, got) if g != want(p[1], p[2])]
    assert not wrong


@pytest.mark.parametrize("path, version, rest", [
    ("/stable/modules/x.html", "stable", "/modules/x.html"), ("/0.24/user_guide/a.html", "0.24", "/user_guide/a.html"), ("/en/stable/install.html", "stable", "/install.html"),
    ("/install.html", None, "/install.html"), ("/v2/api", "v2", "/api"), ("/en/install", None, "/en/install"), ("/dev", "dev", "/"), ("/en", None, "/en"), ("/", None, "/"), ("/Latest/a/", "Latest", "/a"),
])
def test_version(spark, path, version, rest):
    got = column(spark, [path], urls.version_of)[0]
    assert (got.version, got.version_free_path) == (version, rest)


def test_assets_and_skips(spark):
    assert column(spark, ["https://h/a.css", "https://h/a.CSS?x#y", "https://h/a.html", "https://h/a", "https://x.zip", "https://h/a.png/"], urls.is_asset) == [True, True, False, False, True, True]
    skips = ["ftp://h/a", "https://h/a.py", "https://h/feed/", "https://h/x/feed/y", "https://h/wp-json/a", "https://h/a.html", "https://h/a.md?x", "mailto:a@b", "https://h/rss"]
    assert column(spark, skips, urls.should_skip) == [True, True, True, True, True, False, True, True, True]


def test_internal(spark):
    made = ["https://www.h.com/a", "https://docs.h.com:8080/", "https://other.com/", "https://noth.com/"]
    assert column(spark, made, lambda u: urls.is_internal(u, "h.com")) == [True, True, False, False]


SEGMENTS = {
    "123e4567-e89b-12d3-a456-426614174000": "uuid", "2024-01-31": "date", "v2": "version", "0.24": "version", "3.14": "version", "123": "integer", "deadbeef": "hash",
    "sklearn.linear_model.LogisticRegression": "dotted_path", "theme.css": "literal", "index.html": "filename", "LogisticRegression": "camel_case", "linear-model": "slug",
    "user_guide": "literal", "sklearn.svm.SVC.html": "filename", "x": "literal",
}


def test_segment_types(spark):
    assert column(spark, list(SEGMENTS), segments.classify) == list(SEGMENTS.values())
    assert column(spark, ["abc", "Abc", "a.b", "a-b_c", "1a", "a\n"], segments.is_literal_like) == [True, False, False, True, False, False]
