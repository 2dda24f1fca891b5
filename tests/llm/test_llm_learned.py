"""Operators tested by accuracy, recall and planted cases: language, search, extraction; and the pipeline as a whole."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblode.llm import ann, langid, neardup, packing, pii, queries, template

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- language ---------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    rows = [(i, "der die das und nicht " * 9, "de") for i in range(30)] + [(i + 30, "the and of this with " * 9, "en") for i in range(30)]
    odd = [(100, None, "de"), (101, "", "en"), (102, "12 !? 34", None), (103, "日本語", None), (None, "the and of", None), (104, "UND DIE " * 40_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumn("_text", F.lit("clash"))
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [found[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and found[100].score == 0
    assert found[103].lang_pred in ("de", "en")
    assert (found[None].lang_pred, found[104].lang_pred) == ("en", "de")
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_signs_that_are_no_letters(spark):
    rows = [(i, "some english words to learn from " * 3, "en") for i in range(20)] + [(90, "½ ² ① Ⅳ ⁿ٣ ⓐ"[:8], None), (91, "½ word ²", None)]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert (found[90].lang_pred, found[90].score, found[91].lang_pred) == ("und", 0.0, "en")


def test_cross_parsing_takes_longest_matches():
    learned, text = "abracadabra banana", "bracad bananab zz"
    model = langid.Model({"x": learned})
    phrases, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in learned:
            size += 1
        phrases, at = phrases + 1, at + size
    assert model.counts([text])[0, 0] == phrases


# --- nearest neighbours -----------------------------------------------------------------------


def test_automata_follow_the_text_not_the_alphabet():
    """Thousands of letters: transitions take little room and still parse into longest matches."""
    rng = np.random.default_rng(2)
    text = rng.integers(1, 3000, 20_000).astype(np.int16)
    automaton = langid.SuffixAutomaton(text, 3001)
    assert sum(x.nbytes for x in (automaton.base, automaton.owner, automaton.to, automaton.root)) < 2_000_000
    learned = text.tobytes()
    parsed = np.concatenate([text[500:530], rng.integers(0, 3000, 40).astype(np.int16), text[9:60]])

    def holds(part):
        at = learned.find(part.tobytes())
        while at > 0 and at % 2:
            at = learned.find(part.tobytes(), at + 1)
        return at >= 0

    ended, start = 0, 0
    for end in range(1, len(parsed) + 1):
        if not holds(parsed[start:end]):
            ended += 1
            start = end - 1 if holds(parsed[end - 1 : end]) else end
    assert automaton.phrases(parsed[:, None]).tolist() == [ended]


def exact(rows, k):
    """(query, candidates in order) by comparing everything in double precision."""
    out = {}
    for i, v, asks in rows:
        if asks and i not in out:
            scored = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w, _ in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("cell", [2000, 60])
def test_nearest_neighbours_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 24)) * 3
    vectors = centres[rng.integers(0, 8, 700)] + rng.standard_normal((700, 24)) * rng.uniform(0.2, 2, (700, 1))
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    data += [(700 + i, data[0][1]) for i in range(150)]  # one vector many times over
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [float("inf")] * 24), (9005, [1.0]), (9006, [None] * 24), (9007, [])]
    frame = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<float>").withColumn("cell", F.lit("clash"))
    found = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact([(i, v, i % 20 == 0) for i, v in data], 20)
    assert set(found) == set(want)
    hits = 0
    for i, near in want.items():
        assert [r for r, _, _ in found[i]] == list(range(1, 21))
        assert [s for _, _, s in found[i]] == sorted((s for _, _, s in found[i]), reverse=True)
        hits += len({j for j, _ in near} & {j for _, j, _ in found[i]})
    assert hits >= 0.95 * 20 * len(want)
    assert [j for _, j, _ in found[720]] == [j for j, _ in want[720]]  # ties to the smaller id
    few = ann.nearest(frame.filter("vec_id < 3 OR vec_id > 9000"), F.col("vec_id") == 0)
    assert few.count() == 2
    assert ann.nearest(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert ann.chi_square_quantile(0.95, 12) == pytest.approx(21.026, abs=1e-3)


# --- pages ------------------------------------------------------------------------------------


def page(i, body, host="a.example"):
    frame = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        f"{body}<aside>More</aside><div id=comments><p>Reader says {i}</p></div><form>Send <button>Go</button></form>"
        "<footer>&copy; Site</footer></body></html>"
    )
    return (i, f"https://{host}/p/{i}", frame)


def test_extraction_keeps_the_article_only(spark):
    inside = "<article><h1>Head  &amp; line {i}</h1><p>One <b>bold</b>&nbsp;word<p>Two\n lines<div class=ad>Buy</div><ul><li>x<li>y</ul><!-- no --><div class='shadow'>kept</div></article>"
    bare = "<div class=story><p>Open text number {i} with more words</p><p>and {i} again</p></div><div class=box><p>Follow us everywhere</p></div>"
    rows = [page(i, inside.format(i=i)) for i in range(30)] + [page(100 + i, bare.format(i=i), "b.example") for i in range(30)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://c/1", "<p>a &lt;b&gt; &#8364;<script>x"), (203, "http://c/2", "plain < text"), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in template.extract(frame).collect()}
    for i in range(30):
        assert found[i].text == f"Head & line {i}\nOne bold word\nTwo lines\nx\ny\nkept"
        # No marked container: constant text goes, the open slot stays.
        assert found[100 + i].text == f"Open text number {i} with more words\nand {i} again"
    assert (found[200].text, found[201].text, found[202].text, found[203].text) == ("", "", "a <b> €", "plain < text")
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert template.extract(frame.limit(0)).count() == 0
    assert template.extract(frame).count() == len(rows)


def test_templates_hold_fixed_tokens(spark):
    rows = [page(i, f"<article><p>Own text {i}</p></article>") for i in range(25)]
    given = spark.createDataFrame(rows, "page_id bigint, url string, html string").select(
        F.lit("a.example").alias("host"), F.col("page_id").alias("page"), "html"
    )
    fixed = set(template.templates(given).first().fixed)
    pieces, _ = template.parse(rows[0][2])
    says = {p.text: template.piece_token(p) in fixed for p in pieces}
    assert says["© Site"] and says["Home"] and not says["Own text 0"] and not says["Reader says 0"]


def framed(i, host, body):
    return (i, f"http://{host}/p/{i}", f"<html><body><header>Site</header>{body}<footer>f</footer></body></html>")


def extracted(spark, rows):
    return {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def story(i, host):
    return framed(i, host, f"<div class=story><p>Brought to you by {host}</p><p>Text number {i} is here</p></div>")


def test_templates_belong_to_their_host(spark):
    """Two hosts of one layout whose lines differ, side by side."""
    found = extracted(spark, [story(i, "b.example" if i % 2 else "a.example") for i in range(50)])
    assert found == {i: f"Text number {i} is here" for i in range(50)}


def test_templates_from_three_pages_on_and_not_from_repeats(spark):
    for count in (1, 2, 3, 19):
        rows = [story(i, f"h{count}.example") for i in range(count)]
        fixed = "" if count >= 3 else f"Brought to you by h{count}.example\n"
        want = {i: f"{fixed}Text number {i} is here" for i in range(count)}
        assert extracted(spark, rows) == want
        assert extracted(spark, rows + rows + rows) == want


def test_templates_by_layout(spark):
    """A section of a host has a frame of its own."""
    rows = [story(i, "l.example") for i in range(40)]
    rows += [framed(100 + i, "l.example", f"<div class=shop><p>Price list of the shop</p><p>Item {i} costs so much</p></div>") for i in range(6)]
    found = extracted(spark, rows)
    assert [found[100 + i] for i in range(6)] == [f"Item {i} costs so much" for i in range(6)]


@pytest.mark.parametrize("count", [1, 2, 10])
def test_marked_articles_lose_boxes_not_words(spark, count):
    body = (
        "<main><h1>Title {i}</h1><p>Own text {i}</p><section id=discussion><h2>Discussion</h2><p>We argue {i}</p></section>"
        "<section id=related-work>Others {i}</section><p class=share-price>Up {i}</p><math><mi>x</mi></math><p>Same sentence.</p>"
        "<div class=ad>Buy</div><div class='cookie-notice'>Cookies</div><div id=comments><p>Reader {i}</p></div>"
        "<div><p>Follow us everywhere</p></div></main>"
    )
    found = extracted(spark, [framed(i, "m.example", body.format(i=i)) for i in range(count)])
    kept = "Title {i}\nOwn text {i}\nDiscussion\nWe argue {i}\nOthers {i}\nUp {i}\nx\nSame sentence."
    box = "" if count >= 3 else "\nFollow us everywhere"
    assert found == {i: kept.format(i=i) + box for i in range(count)}


def test_copies_of_an_article_stay_whole(spark):
    page = "<article><h1>One title</h1><div><p>One text</p></div></article>"
    assert set(extracted(spark, [framed(i, "c.example", page) for i in range(5)]).values()) == {"One title\nOne text"}


def plain_templates(pages):
    """Fixed texts per page by comparing occurrence vectors in full."""
    hosts, out = {}, {}
    for page_id, url, html in pages:
        hosts.setdefault(re.match(r"\w+://([^/?#]*)", url)[1].lower(), {})[(url, html)] = template.parse(html or "")
    for host, own in hosts.items():
        vectors, parents = {}, {}
        for page, (pieces, elements) in own.items():
            for path, n in elements.items():
                vectors.setdefault(path, {})[page] = n
                parents[path] = path.rpartition("/")[0]
            for p in pieces:
                key = (p.path, p.text)
                vectors.setdefault(key, {}).setdefault(page, 0)
                vectors[key][page] += 1
                parents[key] = p.path.rpartition("/")[0]
        wide = {k: frozenset(v.items()) for k, v in vectors.items() if len(v) >= 3 and len(v) >= 0.9 * len(own)}
        sizes = collections.Counter(wide.values())
        valid = {k for k, v in wide.items() if sizes[v] > 1}
        out[host] = {k for k in valid if parents[k] == "" or parents[k] in valid}
    return out


def test_templates_match_full_vectors(spark):
    """The given pages, with their container's name changed so that the template decides."""
    given = [(r.page_id, r.url, r.html.replace("article>", "div>")) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    frame = spark.createDataFrame(given, "page_id bigint, url string, html string")
    pages = frame.select(template.host_of(F.col("url")).alias("host"), F.xxhash64("url", "html").alias("page"), "html")
    found = {}
    for r in template.templates(pages.withColumn("html", F.col("html"))).collect():
        found.setdefault(r.host, set()).update(r.fixed)
    for host, keys in plain_templates(given).items():
        tokens = {template._hash(k if isinstance(k, str) else f"{k[0]}\n{k[1]}") for k in keys}
        # Layouts add tokens of their own.
        assert tokens <= found.get(host, set())
    inner = {i: re.search(r"<div><h1>(.*?)(?:</div><footer|$)", h, re.S)[1] for i, _, h in given if "<div><h1>" in h}
    texts = {r.page_id: r.text for r in template.extract(frame).collect()}
    whole = sum(texts[i].split() == template.entities.unescape(re.sub(r"<[^>]*>", " ", t)).split() for i, t in inner.items())
    assert len(inner) > 200 and all(texts.values()) and whole > 0


@pytest.mark.parametrize("junk", ["<!-- x ", "<a ", '<a href="', "<script>", "<p>", "<div>", "<b>", "< ", "</p>", "<ul><li>", "&amp"])
def test_broken_markup_stays_linear(junk):
    import time

    begin = time.process_time()
    template.parse(junk * (400_000 // len(junk)))
    assert time.process_time() - begin < 10


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in template.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        words = template.entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split()
        assert r.text.split() == words


# --- all together -----------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from test_llm_exact import classes, words

    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(9001, None, "en", None, None), (9002, rows[5][1], "en", "src1", 1), rows[7]]
    docs = spark.createDataFrame(rows, DOCS)
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "minhash_near_dedup", "personal_data", "source_mixture", "best_fit_packing"]
    stage = dict(P.STAGES)
    kept = stage[names[0]](spark, docs, SF).cache()
    good = [r for r in kept.collect()]
    assert kept.columns == docs.columns
    assert all(len(words(r.text)) >= 10 for r in good)
    once = stage[names[1]](spark, kept, SF).cache()
    want = set(classes(sorted({(r.doc_id, r.text) for r in good}), 80).values())
    assert sorted(r.doc_id for r in once.collect()) == sorted(want)
    clean = stage[names[2]](spark, once, SF).cache()
    assert clean.columns == docs.columns and clean.count() == once.count()
    assert all(r.n_chars == len(r.text) and not re.search(pii.EMAIL.replace(r"|\G", ""), r.text) for r in clean.collect())
    mixed = stage[names[3]](spark, clean, SF).cache()
    assert mixed.columns == docs.columns
    total = sum(len(words(r.text)) for r in clean.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * total) < 0.1 * total
    packed = stage[names[4]](spark, mixed, SF)
    assert packed.filter("piece = 0").count() == mixed.count()
    assert P.run(spark, SF).count() > 0


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    named = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in named) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in named and set(queries.CHECKS) <= set(entry.oracle_sql())


def test_signature_orders_have_roots_of_their_own():
    roots = [tuple(neardup.tree_order(t)[: neardup.ROOT_DEPTH]) for t in range(neardup.TREES)]
    assert len({h for r in roots for h in r}) == neardup.TREES * neardup.ROOT_DEPTH


def test_encoder_agrees_with_the_tokenizer():
    encoder = packing.Encoder(packing.default_tokenizer())
    odd = ["", "a <|endoftext|> b", "é'S  x\n\n y ", "it's  12½", "İ \x00\x85z ٣٤", "a\r\n\t b  　c ", "😀 ok‍", " " * 3000, "a" * 5000]
    for text in odd:
        assert list(encoder.ids(text)) == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [0]
