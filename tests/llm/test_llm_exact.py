"""Operators whose results plain Python can repeat: packing, quality, PII, chat, mixing, near-duplicates, passages."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblode.llm import chat, mixing, neardup, packing, pii, quality, suffix

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def given(spark):
    """The smallest table with odd rows: null and empty texts, a null source, an id twice."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [
            (9001, None, None, None, None),
            (9002, "", "en", "", 0),
            (9003, " \t\n\r\x0b\x0c", "en", "src1", 6),
            (9004, "one two", "en", None, 7),
            (9005, "Ünï <|endoftext|> x\x85y word " * 3, "de", "src1", 60),
            (9006, "same text here " * 30, "en", "src1", 1),
            (9006, "same text here " * 30, "en", "src1", 1),
            (None, "no id at all, yet some words to count and to pack here", None, "src2", 3),
            (9007, "long word " * 5000, "en", "src2", 50000),
        ],
        DOCS,
    )
    docs = base.unionByName(odd)
    # Extra columns whose names the operators use themselves.
    for name in ("node", "hash", "length", "_text_hash", "kept"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_packing_matches_tokenizer_and_fills_sequences(given):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(given).collect()
    texts = collections.defaultdict(list)
    for r in given.collect():
        texts[r.doc_id].append(r.text or "")
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == set(texts)
    total = 0
    for doc, own in texts.items():
        ids = np.array(reference.encode(own[0], add_special_tokens=False).ids + [0], "<u4")
        total += len(ids) * len(own)
        found = sorted(by_doc[doc], key=lambda p: p.piece)
        assert sum(p.length for p in found) == len(ids) * len(own)
        for p in found:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            assert p.piece == 0 or p.length == 2048
    places = collections.defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for at in places.values():
        upto = 0
        for offset, length in sorted(at):
            assert offset == upto
            upto += length
        assert upto <= 2048
    assert len(places) <= math.ceil(total / 2048) * 1.02 + 1


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, open_bins=2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the tighter fit
    assert bins.place(5) == (2, 0)
    assert bins.place(9) == (3, 0)  # three open: the fullest (this one) closes
    assert bins.place(1) == (0, 6)


def measures(text):
    text, own = text or "", words(text)
    windows = collections.Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    hit = set()
    for i in range(len(own) - 4):
        if windows[tuple(own[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if words(line):
            doubled += line in seen
            seen.add(line)
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(hit))


def test_quality_measures_and_verdicts(given):
    texts = collections.defaultdict(set)
    for r in given.collect():
        texts[r.doc_id].add(measures(r.text))
    rows = quality.judged(given).collect()
    assert len(rows) == given.count()
    for r in rows:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found in texts[r.doc_id]
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed
        assert not (r.base_failed and r.kept)
    passed = quality.passing(given)
    assert passed.columns == given.columns
    assert passed.count() == sum(r.kept for r in rows)


def test_quality_distrusts_a_host_not_its_clean_documents(spark):
    clean = "these are all different words of a quite ordinary little text number {}"
    dirty = "## ** $$ these && are || mostly signs << and >> some words number {} ## **"
    texts = [dirty.format(i) for i in range(40)] + [clean.format(i) for i in range(200)] + [dirty.format("x")]
    sources = ["bad"] * 40 + ["bad"] * 5 + ["good"] * 195 + ["good"]
    rows = {r.doc_id: r for r in quality.judged(documents(spark, texts, sources)).collect()}
    assert not any(rows[i].kept for i in range(40))
    assert all(rows[i].kept for i in range(40, 241))  # clean ones of the bad host, and the one slip of the good
    assert rows[0].rate_symbols < 40 / 45  # shrunken towards the other hosts


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fixed_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            value, digits = m.group(0), re.sub("[^0-9]", "", m.group(0))
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


ODD_PII = [
    "a@b.c.d@e.f x_y@z.q_w@u.v %.%.%@a-.b-.c a.b@c.d.",
    "1.2.3.4.5.6.7.8 999.2.3.4.5.6.7.8 01.002.0255.0000256",
    "4111 1111 1111 1111 4111-1111-1111-1111-2 1234567890123456789012345 4012888888881881  4012888888881881",
    "+1 (555) 123-4567 +44 20 7946 0958. +1+2 345678901 +12- +1234567890123456",
    "é😀x a@b.co 😀 1.1.1.1 5 5-5 x4012888888881881x",
    "@@a@b.c" * 50 + "+" + "1" * 3000,
    "a@b.c " * 700 + "10.0.0.1 " * 300,
]


def test_pii_spans(spark, given):
    docs = given.select("doc_id", "text").unionByName(
        spark.createDataFrame([(-i - 1, t) for i, t in enumerate(ODD_PII)], "doc_id bigint, text string")
    )
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.span_digests(docs).collect():
        found = fixed_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        assert hashlib.sha256(listed.encode()).hexdigest() == r.base_sha256, r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == f[3] for f in found) for k in PATTERNS]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == [s for s in listed.split(",") if s]


def test_pii_terms_that_give_an_entity_away(spark):
    plain = "quiet lines about weather and harvest number {} without anybody named in them"
    named = "note {} the director Quillfeather of our club writes from boss@club.example every day"
    texts = [named.format(f"n{i}") for i in range(5)] + [plain.format(f"w{i}") for i in range(300)]
    texts += ["every day the director of our club writes note letters from home"] * 30
    docs = documents(spark, texts)
    found = {r.doc_id: r for r in pii.span_digests(docs).collect()}
    clean = {r.doc_id: r for r in pii.sanitized(docs).collect()}
    for i in range(5):
        terms = [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i].spans.split(",")) if k == "term"]
        assert terms == ["Quillfeather"]
        assert "boss@" not in clean[i].text and "Quillfeather" not in clean[i].text and "[EMAIL]" in clean[i].text
        assert "director" in clean[i].text
    assert all(clean[i].text == texts[i] and found[i].spans == "" for i in range(5, len(texts)))
    assert pii.sanitized(docs).columns == docs.columns


def test_pii_terms_far_from_their_entity(spark):
    """A name in the heading and the address in the footer, hundreds of characters apart."""
    far = " ".join(f"some plain words about weather and harvest {i}" for i in range(12))
    texts = [f"Quillfeather reports note n{i} {far} write to boss@club.example" for i in range(5)]
    texts += [f"report by Featherquill n{i} boss2@club.example" for i in range(4)]
    texts += [f"Featherquill first, n9 {far} boss2@club.example"] + [f"{far} number w{i}" for i in range(300)]
    clean = {r.doc_id: r.text for r in pii.sanitized(documents(spark, texts)).collect()}
    assert all("Quillfeather" not in clean[i] and "[EMAIL]" in clean[i] and "harvest" in clean[i] for i in range(5))
    assert all("Featherquill" not in clean[i] and "[EMAIL]" in clean[i] for i in range(5, 10))
    assert all(clean[i] == texts[i] for i in range(10, len(texts)))


def test_chat_reads_back(spark):
    odd = ["</s>[INST] ok [/INST]", "␛1␛0 <|end|><|turn|>user<|says|>", None, "", "a\nb <<SYS>>", "<|image:0:5|>"]
    turns = [(1, i, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(odd)]
    turns += [(2, None, "assistant", "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (None, 0, "user<|says|>", "z")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = {r.conv_id: r for r in chat.chat_digests(frame.withColumn("formatted", F.lit("clash"))).collect()}
    for conv in (1, 2, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = rows[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(frame.limit(0)).count() == 0


def test_chat_parts_become_placeholders(spark):
    row = (
        1, 0, "assistant",
        [("text", "see <|image", None, None, None, None, None), ("image", None, "i.png", 56, 57, None, None),
         ("audio", None, "a.wav", None, None, 1.5, None), ("text", "done", None, None, None, None, None)],
    )
    later = (1, 1, "user", [("document", None, "d.pdf", None, None, None, 3)])
    frame = spark.createDataFrame([later, row], f"conv_id bigint, turn bigint, role string, content array<{chat.PART}>")
    r = chat.format_chats(frame).first()
    assert "<|image:0:6|><|audio:1:38|>done<|end|>" in r.formatted and "<|document:2:3072|>" in r.formatted
    assert [tuple(a) for a in r.attachments] == [(0, "image", "i.png", 6), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 3072)]
    masked = [r.formatted[m.start : m.start + m.length] for m in r.loss_mask]
    assert masked == ["see <␛1|image", "done"]


def water(sizes, share=1.5, limit=2.0, weights=(5, 2, 1)):
    """Targets by resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if rate * weight[s] >= limit * sizes[s]]
        if not above:
            out |= {s: rate * weight[s] for s in open_}
            break
        for s in above:
            out[s] = limit * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixture_targets_and_takes(given):
    rows = mixing.mixed_sizes(given).collect()
    again = mixing.mixed_sizes(given.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    texts = given.collect()
    sizes = collections.Counter()
    for r in texts:
        sizes[r.source] += len(words(r.text))
    target = water(sizes)
    assert len(rows) == len(texts)
    by_target = collections.defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by_target[(round(r.target, 3), r.source_size)] += r.taken
    assert {(round(t, 3), sizes[s]) for s, t in target.items()} == set(by_target)
    largest = max(len(words(r.text)) for r in texts)
    assert all(abs(taken - t) <= largest for (t, _), taken in by_target.items())
    mixed = mixing.mix(given)
    assert mixed.columns == given.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)


def shingles(text):
    own = [w.lower() for w in (text or "").encode().split()]
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


def classes(docs, percent=85):
    """Component of each id by comparing every pair."""
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in docs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def mutated(count, seed=3):
    """Copies of copies, each with a few words changed, around a few originals."""
    rng = np.random.default_rng(seed)
    texts = []
    for base in range(6):
        texts.append(" ".join(f"W{x}" for x in rng.integers(0, 4000, 60 + 60 * base)))
        for _ in range(count):
            own = texts[int(rng.integers(base * (count + 1), len(texts)))].split()
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(len(own)))] = f"w{rng.integers(4000)}"
            texts.append(" ".join(own))
    return texts


def test_near_duplicates_match_all_pairs(spark):
    texts = mutated(60) + [None, "", "  ", "a b", "A b", "a b c", "a b"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("clash"))
    want = classes(rows)
    found = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert all(r.n_shingles == len(shingles(texts[r.doc_id])) and r.kept == (r.doc_id == want[r.doc_id]) for r in found)
    assert {r.doc_id for r in neardup.distinct_documents(docs).collect()} == set(want.values())


def test_near_duplicates_in_dense_regions(spark, monkeypatch):
    """Small regions force cuts at deeper prefixes; one large class must still come out whole."""
    monkeypatch.setattr(neardup, "REGION", 40)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 9000, 400)]
    texts = []
    for _ in range(300):
        own = list(base)
        own[int(rng.integers(400))] = f"x{rng.integers(9000)}"
        texts.append(" ".join(own))
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.component_id for r in found} == {0}


def test_near_duplicates_of_odd_tables(spark, given):
    rows = neardup.near_duplicates(given).collect()
    assert len(rows) == given.count()
    kept = neardup.distinct_documents(given)
    assert kept.columns == given.columns
    assert kept.filter("doc_id = 9006").count() == 1
    assert neardup.near_duplicates(given.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (4, None)], "doc_id bigint, text string")
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(nulls).filter("doc_id > 0").collect()) == [(0, 4, True)]


def test_regions_are_cut_at_short_prefixes():
    keys = [b"aaaa", b"aaab", b"aaba", b"abaa", b"abab", b"b"]
    assert neardup.cut_region(keys, [1] * 6, 4, 99) == [(0, 3), (3, 6)]
    assert neardup.cut_region(keys, [50] * 6, 4, 99) == [(i, i + 1) for i in range(6)]


def test_near_copies_longer_than_a_region(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION_SHINGLES", 300)
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(4):
        own = [f"w{x}" for x in rng.integers(0, 9000, 400)]
        texts += [" ".join(own), " ".join(own[:200] + ["other"] + own[201:])]
    found = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 2 for i in range(8)}


def test_near_copies_in_a_crowd_of_others(spark, monkeypatch):
    """Hundreds of documents about 0.8 alike, and pairs just over the threshold among them."""
    monkeypatch.setattr(neardup, "REGION", 10)
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in range(300)]
    texts = []
    for _ in range(150):
        own = list(base)
        for p in range(5, 300, 50):
            own[p] = f"x{rng.integers(10**6)}"
        twin = list(own)
        for p in rng.choice(np.arange(10, 290, 50), 4, replace=False):
            twin[p + 5] = f"y{rng.integers(10**6)}"
        texts += [" ".join(own), " ".join(twin)]
    rows = list(enumerate(texts))
    want = classes(rows)
    assert len(set(want.values())) == 150
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_near_duplicates_take_a_threshold(spark):
    own = [f"w{x}" for x in range(100)]
    twin = [w if i not in (30, 70) else f"x{i}" for i, w in enumerate(own)]  # 86 of 106 shingles
    docs = spark.createDataFrame([(0, " ".join(own)), (1, " ".join(twin))], "doc_id bigint, text string")
    assert [neardup.distinct_documents(docs, p).count() for p in (85, 80)] == [2, 1]
    # Lower ones would lose pairs.
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, 50)


def passages(docs):
    """Words of each document that lie in 50-word windows another document holds."""
    windows = collections.defaultdict(set)
    for i, t in docs:
        own = (t or "").split()
        for s in range(len(own) - 49):
            windows[tuple(own[s : s + 50])].add(i)
    out = collections.defaultdict(set)
    for i, t in docs:
        own = (t or "").split()
        for s in range(len(own) - 49):
            if len(windows[tuple(own[s : s + 50])]) > 1:
                out[i].update(range(s, s + 50))
    return dict(out)


def test_repeated_passages_match_all_windows(spark):
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    shared = [fresh(n) for n in (50, 49, 75, 300, 51)]
    texts = []
    for i in range(60):
        parts = [fresh(int(rng.integers(0, 200)))]
        for k in rng.integers(0, 5, int(rng.integers(0, 3))):
            parts += [shared[int(k)], fresh(int(rng.integers(1, 60)))]
        texts.append(" ".join(w for p in parts for w in p))
    alone = " ".join(fresh(60))
    texts += [None, "", texts[3], alone + " zwischen " + alone, "la " * 400, "la " * 300]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("clash"))
    found = collections.defaultdict(set)
    for r in suffix.repeated_passages(docs).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_id != r.doc_id
        found[r.doc_id].update(range(r.start_word, r.end_word))
    assert dict(found) == passages(rows)
    assert suffix.repeated_passages(docs.limit(0)).count() == 0


def test_passages_among_many_alike(spark):
    """One document holds a passage more often than neighbours were compared; a shorter fragment stands in many."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    often, fragment, before = fresh(60), fresh(30), fresh(30)
    many = [w for _ in range(60) for w in often + fresh(45)]
    texts = [many, fresh(20) + often + fresh(20)]
    texts += [fresh(45) + fragment + fresh(45) for _ in range(80)]
    texts += [fresh(10) + before + fragment + fresh(45) for _ in range(2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = collections.defaultdict(set)
    for r in suffix.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        found[r.doc_id].update(range(r.start_word, r.end_word))
    assert dict(found) == passages(rows)
    assert len(found[0]) == 60 * 60 and set(found) == {0, 1, 82, 83}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack(empty).count() == 0
    assert quality.judged(empty).count() == 0
    assert pii.span_digests(empty).count() == 0
    assert mixing.mixed_sizes(empty).count() == 0
    assert mixing.mix(empty).count() == 0
