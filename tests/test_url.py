"""URL expressions against the standard library, which defines their rules."""

from __future__ import annotations

import random
from urllib.parse import parse_qs, unquote, urldefrag, urlencode, urljoin, urlparse, urlunparse

import pytest
from conftest import column
from pyspark.sql import functions as F

from weblode.functions import url as U
from weblode.lookups import TRACKING_PARAMS


def want_normal(url, base=None):
    absolute = urldefrag(urljoin(base, url) if base else url)[0]
    return absolute if absolute.startswith(("http://", "https://")) else "https://" + absolute


def want_key(url):
    p = urlparse(url)
    kept = {k: v for k, v in parse_qs(p.query, keep_blank_values=True).items() if k.lower() not in TRACKING_PARAMS}
    path = p.path if p.path == "/" else p.path.rstrip("/")
    return urlunparse((p.scheme, p.netloc.lower(), path, p.params, urlencode(kept, doseq=True), ""))


def want_filename(url):
    return unquote(urlparse(url).path.rsplit("/", 1)[-1]) or "unknown"


def random_urls(count):
    rng = random.Random(11)
    segments = ["a", "b.pdf", "..", ".", "", "c;p=1", "é x", "%20z", "%zz", "d.", "X.HTML", "feed", "~u", "a+b", "q;"]
    queries = ["", "?", "?a=1", "?utm_source=x&a=2", "?b=1&a=2&b=3", "?x", "?Ref=1&k=%20v+w&k=~*", "?&&a==b", "?a=%zz&é=ü"]
    fragments = ["", "#", "#top", "#a?b"]
    hosts = ["http://H.Example.com", "https://www.a.org:80", "https://u@b.net", "http://a.com"]
    loose = hosts + ["HTTP://Q.com", "ftp://f.com", "//n.com", "mailto:x", "", "", "", "javascript:a", "https:", "http:"]

    def one(absolute):
        path = "/".join(rng.choice(segments) for _ in range(rng.randint(0, 5)))
        if absolute:
            path = "/" + path if rng.random() < 0.9 else ""
        elif rng.random() < 0.6:
            path = "/" + path
        return rng.choice(hosts if absolute else loose) + path + rng.choice(queries) + rng.choice(fragments)

    return [(one(False), one(True)) for _ in range(count)]


def test_matches_standard_library(spark):
    pairs = random_urls(3000)
    frame = spark.createDataFrame(pairs, "ref string, base string")
    ref, base = F.col("ref"), F.col("base")
    got = frame.select(
        "ref", "base", U.normalize_url(ref).alias("alone"), U.normalize_url(ref, base).alias("joined"),
        U.crawl_key(base).alias("key"), U.filename_of(base).alias("name"),
    ).collect()
    for r in got:
        assert r.alone == want_normal(r.ref), r
        assert r.joined == want_normal(r.ref, r.base), r
        assert r.key == want_key(r.base), r
        assert r.name == want_filename(r.base), r


def test_crawl_key_is_idempotent(spark):
    # Trimming slashes before an empty parameter mark can expose a second one; the rules allow that.
    urls = [base for _, base in random_urls(500) if ";" not in base]
    frame = spark.createDataFrame([(u,) for u in urls], "u string").select(U.crawl_key(F.col("u")).alias("k"))
    assert frame.filter(U.crawl_key(F.col("k")) != F.col("k")).count() == 0


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://E.com/a/?utm_source=x", "https://e.com/a"),
        ("https://e.com/?b=1&a=2&b=3", "https://e.com/?b=1&b=3&a=2"),
        ("https://e.com", "https://e.com"),
        ("https://e.com/", "https://e.com/"),
        ("https://www.e.com/a#x", "https://www.e.com/a"),
        ("http://e.com/a?x&REF=1", "http://e.com/a?x="),
    ],
)
def test_crawl_key_cases(spark, url, key):
    assert column(spark, [url], U.crawl_key) == [key]


def test_unbalanced_bracket_is_dropped(spark):
    assert column(spark, ["http://[::1/x", "http://[::1]/x"], lambda c: U.normalize_url(c, F.lit("http://a.com/"))) == [
        None, "http://[::1]/x",
    ]


def test_extensions(spark):
    urls = ["http://h/a.PDF", "http://h/a", "http://h/est.", "http://h/a.b.tar.gz", "http://h/a.verylongextension", "http://h/a.t_x?b.c", "http://h/"]
    assert column(spark, urls, U.extension_of) == [".pdf", "", ".", ".gz", ".verylongextension", ".tx", ""]


def test_sites_and_skips(spark):
    same = [("http://www.a.com/x", "https://A.com/y", True), ("http://a.com:80", "http://a.com", False), ("http://b.com", "http://a.com", False)]
    frame = spark.createDataFrame(same, "l string, r string, want boolean")
    assert frame.filter(U.same_site(F.col("l"), F.col("r")) != F.col("want")).count() == 0
    urls = ["http://a/x?replytocom=1", "http://a/feed", "http://a/feed/?p=1", "http://a/feed/", "http://a/x?a=1&replytocom=1"]
    assert column(spark, urls, U.is_skipped) == [True, True, True, False, False]


def test_valid_and_display(spark):
    assert column(spark, ["http://a.com", "ftp://a.com", "nope", "", "https://"], U.is_valid_url) == [True, False, False, False, False]
    long = "https://example.com/" + "d/" * 30 + "f.pdf"
    assert column(spark, ["http://a.com", long], lambda c: U.display_url(c, 50)) == ["http://a.com", "example.com/.../f.pdf"]
    assert column(spark, [long], lambda c: U.display_url(c, 20)) == ["https://example.c..."]
