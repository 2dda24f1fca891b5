"""Block-wise running totals, change counts and names against plain loops, with tiny blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weblode.operators import dedup, groups, ordered
from weblode.operators.dedup import dedup_two_key
from weblode.operators.naming import unique_names


@pytest.fixture(params=[1, 2, 18])
def bits(request, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_BITS", request.param)
    # Order values stay below 2 ** (bits * levels).
    return {1: 8, 2: 64, 18: 5000}[request.param]


def skewed(count, limit, seed):
    rng = random.Random(seed)
    orders = rng.sample(range(limit), count)
    return [(o, "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 3)}", rng.choice("aab"), rng.randint(0, 9)) for o in orders]


def test_running_totals(spark, bits):
    data = skewed(min(bits, 60), bits, 1)
    frame = spark.createDataFrame(data, "seq bigint, k string, h string, n bigint")
    got = {r.seq: r.n_running for r in ordered.running_totals(frame, "seq", ["n"]).collect()}
    total, want = 0, {}
    for seq, _, _, n in sorted(data):
        total += n
        want[seq] = total
    assert got == want


def test_running_totals_per_key(spark, bits):
    data = skewed(min(bits, 60), bits, 2)
    frame = spark.createDataFrame(data, "seq bigint, k string, h string, n bigint")
    got = {r.seq: r.n_running for r in ordered.running_totals(frame, "seq", ["n"], ["k"]).collect()}
    totals, want = {}, {}
    for seq, k, _, n in sorted(data):
        totals[k] = totals.get(k, 0) + n
        want[seq] = totals[k]
    assert got == want


def test_changes(spark, bits):
    data = skewed(min(bits, 60), bits, 3)
    frame = spark.createDataFrame(data, "seq bigint, k string, h string, n bigint")
    got = {r.seq: r.changes for r in ordered.changes_so_far(frame, ["k"], "seq", "h").collect()}
    last, count, want = {}, {}, {}
    for seq, k, h, _ in sorted(data):
        count[k] = count.get(k, 0) + (k in last and last[k] != h)
        last[k] = h
        want[seq] = count[k]
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_two_key_dedup_equals_loop(spark, seed):
    rng = random.Random(seed)
    data = [(i, f"u{rng.randint(0, 14)}", f"{rng.choice('Nn')}{rng.randint(0, 11)}") for i in range(90)]
    kept, skipped = dedup_two_key(spark.createDataFrame(data, "seq bigint, url string, filename string"))
    urls, names, want_kept, want_skipped = set(), set(), [], []
    for seq, url, name in data:
        if url in urls:
            continue
        if name.lower() in names:
            want_skipped.append(seq)
            continue
        urls.add(url)
        names.add(name.lower())
        want_kept.append(seq)
    assert sorted(r.seq for r in kept.collect()) == want_kept
    assert sorted(r.seq for r in skipped.collect()) == want_skipped


def chain(spark, count):
    return spark.range(count).selectExpr("id AS seq", "'u' || (id + 1) div 2 AS url", "'N' || id div 2 AS filename")


@pytest.mark.parametrize("limit", [200_000, 3])
def test_two_key_dedup_of_chains(spark, monkeypatch, limit):
    """Chains in one pass where groups are small enough, in rounds where they aren't: the same rows."""
    monkeypatch.setattr(dedup, "GROUP_ROWS", limit)
    count = 2_000 if limit > 3 else 12
    kept, skipped = dedup_two_key(chain(spark, count))
    assert sorted(r.seq for r in kept.collect()) == list(range(0, count, 2))
    assert sorted(r.seq for r in skipped.collect()) == list(range(1, count, 2))


def test_long_chain_takes_few_jobs(spark):
    spark.sparkContext.setJobGroup("long-chain", "")
    kept, _ = dedup_two_key(chain(spark, 10_000))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long-chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept.count() == 5_000
    # Stages of adaptive plans count as jobs: three steps, none of them per link of the chain.
    assert jobs < 60


@pytest.mark.parametrize("seed", range(2))
def test_two_key_dedup_in_stretches_equals_loop(spark, monkeypatch, seed):
    """Groups far larger than a stretch, with chains in any direction and rows that hang on two open values."""
    monkeypatch.setattr(dedup, "GROUP_ROWS", 25)
    rng = random.Random(seed)
    data = [(i, f"u{(i + 1) // 2 + 7 * rng.randint(0, 1) * (i % 9 == 0)}", f"n{i // 2 + 5 * rng.randint(0, 1) * (i % 11 == 0)}") for i in range(150)]
    frame = spark.createDataFrame(data, "seq bigint, url string, _name string").withColumn("_row", F.col("seq"))
    urls, names, want, left, got = set(), set(), [], frame, []
    for seq, url, name in data:
        if url not in urls and name not in names:
            urls.add(url)
            names.add(name)
            want.append(seq)
    passes = 0
    while not left.isEmpty():
        kept, left = dedup._in_stretches(left, "seq")
        got += [r.seq for r in kept.collect()]
        passes += 1
    assert sorted(got) == want and passes < 6


def test_chain_over_many_stretches_takes_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "GROUP_ROWS", 100)
    spark.sparkContext.setJobGroup("stretches", "")
    kept, _ = dedup_two_key(chain(spark, 3_000))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stretches"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept.count() == 1_500
    # In rounds the chain would take one for every other link.
    assert jobs < 150


@pytest.mark.parametrize("per_task", [7, 1000])
def test_connected_matches_union_find(spark, monkeypatch, per_task):
    monkeypatch.setattr(groups, "PAIRS_PER_TASK", per_task)
    rng = random.Random(per_task)
    pairs = [(rng.randrange(60) * 7919 - 10**6, rng.randrange(60) * 104729) for _ in range(45)] + [(i, i + 1) for i in range(10**6, 10**6 + 30)]
    above = {n: n for p in pairs for n in p}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        p, q = root(a), root(b)
        above[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in groups.connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {n: root(n) for n in above}
    assert groups.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_two_key_dedup_of_nothing(spark):
    kept, skipped = dedup_two_key(spark.createDataFrame([], "seq bigint, url string, filename string"))
    assert kept.count() == 0 and skipped.count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    names = [rng.choice(["a.txt", "a.txt", "b", "a.tar.gz", "c_1.pdf", "c.pdf"]) for _ in range(50)]
    present = {"a.txt", "a_2.txt", "a_3.txt", "b_1", "zzz"}
    files = spark.createDataFrame(list(enumerate(names)), "seq bigint, filename string")
    existing = spark.createDataFrame([(n,) for n in present], "saved_name string")
    got = {r.seq: r.saved_name for r in unique_names(files, existing).collect()}
    # Names other files own as they are count as taken for numbering.
    taken = present | set(names)
    want, used = {}, set()
    for seq, name in enumerate(names):
        stem, dot, ext = name.rpartition(".") if "." in name else (name, "", "")
        number, choice = 0, name
        while choice in used or (choice in (present if number == 0 else taken)):
            number += 1
            choice = f"{stem}_{number}{dot}{ext}"
        used.add(choice)
        want[seq] = choice
    assert got == want
    assert len(set(got.values())) == len(names)


def test_ordinals(spark, bits):
    data = [(i * 3 % bits,) for i in range(min(bits // 3, 20))]
    frame = spark.createDataFrame(data, "seq bigint")
    got = {r.seq: r.ordinal for r in ordered.ordinals(frame, "seq").collect()}
    assert got == {s: i + 1 for i, (s,) in enumerate(sorted(data))}
    assert frame.select(F.max("seq")).first()[0] < bits
