"""Scalar functions: sizes, names, labels, errors, requests, replies, settings."""

from __future__ import annotations

import os
import random

import pytest
from conftest import column
from pyspark.sql import functions as F

from weblode.functions import errors as X
from weblode.functions import sizes as Z
from weblode.functions import text as T
from weblode.functions.replies import parse_reply, unfence
from weblode.functions.requests import check_url
from weblode.operators import settings as G


def test_sizes(spark):
    values = [500, 1024, 1048576, 1073741824, 0, None, -100, 2621440, 11520, 1048575, 2**50]
    assert column(spark, values, Z.format_size, "bigint") == [
        "500 B", "1.0 KB", "1.0 MB", "1.0 GB", "0 B", None, None, "2.5 MB", "11.2 KB", "1024.0 KB", "1024.0 TB",
    ]
    assert column(spark, [11520, 0, None], Z.format_size_ui, "bigint") == ["11.3 KB", "0 B", None]
    assert column(spark, [0, None, 1536], Z.format_size_history, "bigint") == ["0 B", "0 B", "1.5 KB"]


def test_sizes_round_like_python(spark):
    rng = random.Random(5)
    values = [rng.randint(0, 2 ** rng.randint(1, 45)) for _ in range(2000)]

    def want(size):
        if size < 1024:
            return f"{size} B"
        number, unit = float(size), 0
        while number >= 1024 and unit < 4:
            number, unit = number / 1024, unit + 1
        return f"{number:.1f} {['B', 'KB', 'MB', 'GB', 'TB'][unit]}"

    assert column(spark, values, Z.format_size, "bigint") == [want(v) for v in values]


def test_durations(spark):
    assert column(spark, [0.4, 59.5, 60.0, 61.0, 3600.0, 5430.0, None], Z.format_duration, "double") == [
        "0s", "60s", "1m", "1m 1s", "1h 0m", "1h 31m", None,
    ]
    assert column(spark, [0.0, None, 120.0, 45.0, -1.0], Z.format_eta, "double") == ["Calculating...", "Calculating...", "2m 0s", "45s", "Calculating..."]


def test_strip_matches_python(spark):
    values = ["  x 　", "\x0b\x1cx\x85", "​x", "  ", "", "a b"]
    assert column(spark, values, T.strip) == [v.strip() for v in values]


def test_sanitize(spark):
    names = ['a<b>:"/\\|?*.txt', "  . x . ", "", "...", "x" * 300 + ".pdf", "n" * 250, ".", "a." + "e" * 300]
    got = column(spark, names, T.sanitize_filename)

    def want(name):
        for char in '<>:"/\\|?*':
            name = name.replace(char, "_")
        name = name.strip(" .") or "unnamed_file"
        stem, suffix = os.path.splitext(name)
        return name if len(name) <= 200 else stem[: 200 - len(suffix)] + suffix

    assert got == [want(n) for n in names]


def test_split_name_matches_splitext(spark):
    names = ["a.txt", ".bashrc", "a.tar.gz", "..x", "...a.b", "noext", "a.", ".a.b", "x..y"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    stem, suffix = T.split_name(F.col("n"))
    for r in frame.select("n", stem.alias("a"), suffix.alias("b")).collect():
        assert (r.a, r.b) == os.path.splitext(r.n)


def test_labels(spark):
    assert column(spark, [".pdf", "PDF", " .Xlsx ", "xyz", ".weird", ""], T.type_label) == [
        "PDF Document", "PDF Document", "Excel Spreadsheet", "XYZ File", "WEIRD File", " File",
    ]
    assert column(spark, [".PDF", ".csv", ".zip"], T.mime_type) == ["application/pdf", "text/csv", "application/octet-stream"]


def test_disposition(spark):
    headers = ['attachment; filename="a.pdf"', "attachment; filename=b.pdf; size=3", "inline", None, "filename=''", "filename='c'; filename=d"]
    assert column(spark, headers, T.disposition_filename) == ["a.pdf", "b.pdf; size=3", None, None, None, "c'; "]


def test_previews(spark):
    assert column(spark, ["x" * 301, "x" * 300, None], T.preview) == ["x" * 300 + "...", "x" * 300, None]
    assert column(spark, ["abcdef", "abc"], lambda c: T.truncate(c, 5)) == ["ab...", "abc"]
    prompt = column(spark, ["y" * 12001], lambda c: T.build_prompt(F.lit("f.txt"), c))[0]
    assert prompt == "Document filename: f.txt\n\nDocument content:\n" + "y" * 12001
    second = column(spark, ["y"], lambda c: T.build_prompt(F.lit("f.txt"), c, F.lit(2), F.lit(3)))[0]
    assert second == "Document filename: f.txt\n\nDocument content (part 2 of 3):\ny"
    cut = column(spark, ["abcde", "abcd", "", None], lambda c: F.array_join(T.text_parts(c, 2), "|"))
    assert cut == ["ab|cd|e", "ab|cd", "", ""]


def test_request_urls(spark):
    cases = {
        "  example.com ": ("https://example.com", None),
        "http://localhost:80/x": ("http://localhost:80/x", None),
        "": (None, "Please enter a website address"),
        "https://": (None, "Please enter a valid website address (e.g. example.com)"),
        "foo": (None, "That doesn't look like a complete website address. Did you mean foo.com?"),
        "a.com/b c": (None, "The website address contains spaces. Please check for typos and try again"),
        "a.b": (None, "The website address doesn't have a valid ending (like .com or .org). Please check the address and try again"),
    }
    got = column(spark, list(cases), check_url)
    assert [(r.url, r.error) for r in got] == list(cases.values())


def test_retry_rules(spark):
    errors = ["API returned HTTP 429", "HTTP 401", "Timed Out", "it timed out", "Connection failed: x", None, "HTTP 5000"]
    assert column(spark, errors, X.is_retryable) == [True, False, False, True, True, False, True]
    waits = ["Retry-After: 30s", "Retry-After: 2s", "none", "Retry-After: soon"]
    assert column(spark, waits, lambda c: X.retry_delay(c, 0)) == [30, 5, 5, 5]


def test_connection_classes(spark):
    texts = ["[Errno 111] x", "no such host", "Authentication failed", "Timeout", "bad CERTIFICATE", "author timed out", "?"]
    assert column(spark, texts, X.connection_error_class) == ["refused", "host", "auth", "timeout", "tls", "auth", "other"]
    assert column(spark, ["z" * 200], X.connection_error_message) == ["Connection failed: " + "z" * 200]


def test_replies(spark):
    replies = [
        '{"title": " T ", "summary": " s ", "keywords": ["a ", "", 3, null, true, 0], "document_type": "memo"}',
        '```json\n{"summary": "x"}\n```', '{"summary": 5}', "oops", "[1]", '{"summary": "   "}', '{"summary": "x", "keywords": "no"}', "",
    ]
    got = column(spark, replies, parse_reply)
    assert (got[0].title, got[0].summary, got[0].document_type) == ("T", "s", "memo")
    assert got[0].keywords[:2] == ["a", "3"] and len(got[0].keywords) == 3
    assert (got[1].summary, got[1].keywords, got[1].document_type, got[1].title) == ("x", [], "other", "")
    assert [r.error is not None for r in got] == [False, False, True, True, True, False, False, True]
    assert got[5].summary == "" and got[6].keywords == []
    assert column(spark, ["```\na\n  ```b\nc"], unfence) == ["a\nc"]


def settings(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value string")


def values(frame):
    return {r.key: r.value for r in frame.collect()}


def test_settings_defaults_and_overrides(spark):
    stored = settings(spark, [("ai_model", '"m"'), ("gone", "1")])
    now = values(G.effective(G.defaults(spark), stored))
    assert len(now) == 13 and now["ai_model"] == '"m"' and now["max_crawl_depth"] == "10"


def test_settings_updates(spark):
    current = G.effective(G.defaults(spark), settings(spark, [("ai_api_key", '"k"'), ("mongodb_uri", '"u"')]))
    updates = settings(
        spark,
        [
            ("ai_api_key", '"********"'), ("mongodb_uri", '""'), ("ai_model", '" m "'), ("stirling_pdf_url", '""'),
            ("max_crawl_depth", "99"), ("default_crawl_depth", "50"), ("request_timeout", "1"), ("requests_per_second", "0.25"), ("nope", "1"),
        ],
    )
    now = values(G.apply_updates(current, updates))
    assert now["ai_api_key"] == '"k"' and now["mongodb_uri"] == '"u"' and now["ai_model"] == '"m"'
    assert now["stirling_pdf_url"] == '""' and now["max_crawl_depth"] == "10" and now["default_crawl_depth"] == "10"
    assert now["request_timeout"] == "5" and now["requests_per_second"] == "0.5" and "nope" not in now
    assert values(G.masked(settings(spark, [("ai_api_key", '"k"')]))) == {"ai_api_key": '"********"'}
    assert values(G.masked(settings(spark, [("ai_api_key", '""')]))) == {"ai_api_key": '""'}


@pytest.mark.parametrize("value", ["x", 5, 1.5, True, ["a", 1], {"k": [1]}])
def test_settings_round_trip(spark, value):
    import json

    stored = G.set_setting(settings(spark, [("a", "1"), ("b", "2")]), "a", value)
    text = stored.filter("key = 'a'").select(F.to_json(F.struct(G.decode(F.col("value")).alias("v")))).first()[0]
    assert json.loads(text)["v"] == value
    assert values(G.delete_setting(stored, "a")) == {"b": "2"}
    raw = settings(spark, [("r", "not json")]).select(G.decode(F.col("value")).cast("string")).first()[0]
    assert raw == "not json"
