"""Address rules with aliases, fill-in-the-middle and importance resampling, against plain Python."""

from __future__ import annotations

import collections
import hashlib
import html as markup
import math
import random
import re
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weblode.llm import fim, resample, urlfilter
from weblode.llm.queries import URL_RULES, op12_piece_table, op13_importance_resampling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string"
ODD = [
    (9001, None, None),
    (9002, "", "en"),
    (9003, "\n", "en"),
    (9004, "no line feed at the end\nlast", "en"),
    (9005, "has <S> inside\nplain\n", "en"),
    (9006, "Ünï çødé\n\n\r\n漢字 and \U0001f600 words\n" * 7, "de"),
    (9006, "Ünï çødé\n\n\r\n漢字 and \U0001f600 words\n" * 7, "de"),
    (None, "no id <\nbut < P> lines\n" * 12, None),
    (9007, "long line of words " * 20_000 + "\n" + "x\n" * 3_000, "en"),
    (9008, "İSTANBUL Kelvin K don't\x00stop A1 b_c " * 5, "tr"),
]


@pytest.fixture(scope="module")
def given(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = base.unionByName(spark.createDataFrame(ODD, DOCS))
    for name in ("fim", "t", "w", "row", "rank", "score", "h", "restored", "output"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.cache()


# --- fill in the middle ------------------------------------------------------------------------


def middle(doc_id, text, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("character", r"(?s).")])
def test_fim_matches_plain_python(given, unit, pattern):
    out = fim.restored(fim.arranged(given, unit=unit), "fim.output", "fim.form")
    assert set(out.columns) == set(given.columns)
    forms = collections.Counter()
    for row in out.select("doc_id", "text", "fim.*", F.col("restored").alias("back"), F.col("lang")).collect():
        n, form, before, between, output = middle(row.doc_id, row.text, pattern)
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == (n, form, before, between, output)
        assert row.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert row.back["text"] == (row.text or "")
        assert row.back["sha256"] == hashlib.sha256((row.text or "").encode()).hexdigest()
        forms[form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) >= 3


def test_fim_digests_of_all_documents(spark, given):
    rows = fim.fim_digests(given).collect()
    assert len(rows) == given.count()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in given.collect())
    assert op12_piece_table(spark, SF).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert fim.fim_digests(given.limit(0)).count() == 0


def test_fim_rates_and_sentinels(given):
    assert fim.arranged(given, rate=0).filter("fim.form <> 'plain'").isEmpty()
    marks = ("<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>")
    out = fim.restored(fim.arranged(given, rate=50, sentinels=marks), "fim.output", "fim.form", marks)
    counts = {r[0]: r[1] for r in out.groupBy("fim.form").count().collect()}
    assert 0.35 < counts["plain"] / sum(counts.values()) < 0.65
    assert out.filter("restored.text <> coalesce(text, '')").isEmpty()
    for bad in (("a", "b", "a"), ("<", "<<", "|"), ("", "b", "c"), ("ab", "ba", "x")):
        with pytest.raises((ValueError, IndexError)):
            fim.arranged(given, sentinels=bad)


def test_descriptors():
    whole = (fim.TEXT, 3, 10)
    parts = fim.split(whole, 2, 2)
    assert parts == [(0, 3, 2), (0, 5, 0), (0, 5, 8)]
    for order in fim.ARRANGEMENTS.values():
        assert fim.permute(fim.permute(parts, order), fim.inverse(order)) == parts
    data = memoryview(b"0123456789abc")
    assert fim.written(parts, [data]) == b"3456789abc"
    assert fim.streamed(parts, [data]) == hashlib.sha256(b"3456789abc").hexdigest()


# --- resampling --------------------------------------------------------------------------------


def runs_of(text, longest):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def resampled(docs, target, longest=1, buckets=10_000, percent=10):
    crc = lambda run: zlib.crc32(run.encode()) % buckets
    raw = collections.Counter(crc(r) for _, t in docs for r in runs_of(t, longest)[1])
    wanted = collections.Counter(crc(r) for t in target for r in runs_of(t, longest)[1])
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
    rows = []
    for doc_id, text in docs:
        n, runs = runs_of(text, longest)
        weight = sum(gain(crc(r)) for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return [tuple(r[:5]) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 997, 40)])
def test_resampling_matches_plain_python(spark, given, longest, buckets, percent):
    target = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(-1, None)], "item_id bigint, text string"))
    got = resample.resampled(given, target, percent, longest=longest, buckets=buckets).collect()
    docs = [(r.doc_id, r.text) for r in given.collect()]
    want = resampled(docs, [r.text for r in target.collect()], longest, buckets, percent)
    assert ordered(map(tuple, got)) == ordered(want)


def test_resampling_of_repeated_and_equal_rows(spark):
    """A third of all rows is one row; ranks stay dense and nobody is drawn twice."""
    rows = [(i % 40 if i % 3 else 5, "same words again and again " * 6) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    target = spark.createDataFrame([("words again",)], "text string")
    got = resample.resampled(docs, target, 50).collect()
    assert ordered(map(tuple, got)) == ordered(resampled(rows, ["words again"], percent=50))
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 451))


def test_resampling_of_empty_tables(spark, given):
    target = spark.createDataFrame([], "text string")
    assert resample.resampled(given.limit(0), target).count() == 0
    few = resample.resampled(given.filter("doc_id = 9008"), target).collect()
    assert few[0]["rank"] is None and few[0]["n_features"] == 45
    assert op13_importance_resampling(spark, SF).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_slices_lose_nothing(monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 50)
    texts = pa.array(["a b", None, "c " * 100, "", "d e f", "x" * 80])
    parts = list(resample.slices(texts))
    assert len(parts) > 2 and pa.concat_arrays(parts).equals(texts)
    n, runs = resample.features(texts, 2, 1000)
    assert n.tolist() == [2, 0, 100, 0, 3, 1]
    assert np.bincount(runs[1][0], minlength=6).tolist() == [1, 0, 99, 0, 2, 0]


# --- address rules -----------------------------------------------------------------------------


class Targets(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.base = [], None

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and self.base is None and attrs.get("href"):
            self.base = attrs["href"]
        if tag == "link" and "canonical" in attrs.get("rel", "").lower().split() and attrs.get("href"):
            self.found.append(attrs["href"])
        if tag == "meta" and attrs.get("http-equiv", "").lower() == "refresh":
            match = re.match(r"""(?is)\s*[0-9.]+\s*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']*)""", attrs.get("content", ""))
            if match and match[1].strip():
                self.found.append(match[1].strip())


def key_of(url):
    match = re.match("[^/?#]*://[^/?#]+", (url or "").strip())
    return None if not match else match[0].lower() + url.strip()[match.end() :].split("#")[0]


def rule_of(url, rules):
    match = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (match[1].lower(), match[2]) if match else ("", "")
    best = None
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        if host and (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            if best is None or (len(rule), verdict == "allow") > (len(best[0]), best[1] == "allow"):
                best = (rule, verdict)
    return host, path, best


def verdicts(pages, rules, redirects=()):
    links = collections.defaultdict(set)
    pairs = list(redirects)
    for _, url, html in pages:
        parser = Targets()
        parser.feed(html or "")
        root = url if parser.base is None else urljoin(url or "", parser.base)
        pairs += [(url, urljoin(root or "", t)) for t in parser.found]
    for a, b in pairs:
        a, b = key_of(a), key_of(b)
        if a and b:
            links[a].add(b)
            links[b].add(a)
    out = []
    for page_id, url, _ in pages:
        host, path, best = rule_of(url, rules)
        seen, queue = {key_of(url)}, [key_of(url)]
        while queue:
            for other in links[queue.pop()] - seen:
                seen.add(other)
                queue.append(other)
        near = [r[1] for r in (rule_of(u, rules)[2] for u in seen if u) if r]
        verdict = best[1] if best else "block" if "block" in near and "allow" not in near else "allow"
        out.append((page_id, url, host, path, best and best[0], verdict))
    return out


def linked(url):
    return f'<html><head><link rel="canonical" href="{markup.escape(url)}"></head><body>text</body></html>'


PAGES = [
    (1, "http://a.example.org/de/1", linked("http://bad.example.net/de/1")),  # alias of a blocked page
    (2, "http://b.example.org/de/2", '<meta content="0; URL=/fr/2" http-equiv=Refresh>'),  # alias of an allowed page
    (3, "http://b.example.org/es/3", linked("/de/2") + "<link href='http://x.net/' rel='nofollow Canonical'>"),  # block and allow
    (4, "http://good.EXAMPLE.net/en/4?q=1#x", linked("http://evil.net/4")),  # own allow stays
    (5, "http://bad.example.com/de/5", linked("http://plain.example.com/es/5")),  # own block, passed on to 6
    (6, "http://plain.example.com/es/5#part", None),
    (7, "http://c.example.com/es/7", "<!-- " + linked("http://x.net/") + " --><script>" + linked("http://x.net/") + "</script>"),
    (8, "http://c.example.com/es/8", "<base href='http://chain.example.com/k/'><link rel=canonical href=../0>"),
    (9, None, linked("http://x.net/")),
    (10, "no address", None),
    (11, "http://net", ""),
    (12, "http://net/", ""),
    (13, "http://ynet/a", ""),
    (14, "http://h.example.com", "<link rel=canonical href=" + "z" * 50_000),
    (15, "http://h.example.com?to=://x.net/", "<meta " + "a " * 30_000 + "http-equiv=refresh content='5'>"),
    (16, "http://" + "deep." * 5_000 + "net/en/", ""),
    (17, "http://r.example.com/es/17", ""),
    (17, "http://r.example.com/es/17", ""),
    (None, "http://r.example.com/es/18", ""),
]


def chain(count, last):
    return [(100 + i, f"http://chain.example.com/{i}", linked(f"/{i + 1}" if i + 1 < count else last)) for i in range(count)]


def test_verdicts_match_plain_python(spark):
    pages = PAGES + chain(40, "http://far.net/")
    pages += [(1000 + i, f"http://copy{i}.example.com/es/", linked("http://hub.example.com/es/")) for i in range(60)]
    redirects = [("http://hub.example.com/es/#a", "HTTP://Far.Example.com/de/"), ("http://r.example.com/es/17", "http://y.net/"), (None, "http://x.net/")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for name in ("host", "rule", "node", "_node", "targets", "_best", "verdict", "candidates"):
        frame = frame.withColumn(name, F.lit("clash"))
    edges = spark.createDataFrame(redirects, "src string, dst string")
    rules = urlfilter.rule_table(spark, URL_RULES)
    want = verdicts(pages, URL_RULES, redirects)
    got = urlfilter.judged(frame, rules, edges).collect()
    text = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert text(got) == text(want)
    by_id = {r.page_id: r.verdict for r in got}
    assert [by_id[k] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["block", "allow", "allow", "allow", "block", "block", "allow", "block", "allow"]
    assert by_id[100] == by_id[139] == by_id[1000] == by_id[17] == "block"
    assert text(urlfilter.judged(frame, rules).collect()) == text(verdicts(pages, URL_RULES))


def test_rules_of_many_lengths(spark):
    rng = random.Random(4)
    names = ["a", "b", "a.b", "b.a.b", "c.b"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(names) + rng.choice(["", "/", "/x", "/x/", "/x/y", "/xz"])) for _ in range(25)]
    pages = [(i, f"http://{rng.choice(['', 'q.', 'a.', 'b.a.'])}{rng.choice(names).upper()}{rng.choice(['', '/', '/x', '/x/y/z', '/xz?x'])}", None) for i in range(300)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = urlfilter.judged(frame, urlfilter.rule_table(spark, rules)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, verdicts(pages, rules)))


def test_url_filter_of_nothing(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urlfilter.judged(none, urlfilter.rule_table(spark, URL_RULES)).count() == 0
    some = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    assert urlfilter.judged(some, urlfilter.rule_table(spark, [])).filter("verdict <> 'allow'").isEmpty()
