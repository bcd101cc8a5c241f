"""Fingerprints, multi-index search and components against brute force."""

import random
import re

import pytest
import xxhash
from frames import AWKWARD, DOCS, clashing, docs
from pyspark.sql import functions as F

from pelagos.llm.components import components
from pelagos.llm.simhash import drop_near_duplicates, near_components, segment_plan, simhash_dedup


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    own = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_documents(spark):
    rng = random.Random(1)
    base = [f"word{rng.randrange(400)}" for _ in range(600)]
    texts = list(AWKWARD)
    for _ in range(25):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own).title() if rng.random() < 0.3 else " ".join(own))
    got = {r.id: r for r in simhash_dedup(clashing(docs(spark, texts))).collect()}
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    top = roots(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    groups = {}
    for i, p in prints.items():
        groups.setdefault(top[p], []).append(i)
    assert {i: r.component_id for i, r in got.items()} == {i: min(g) for g in groups.values() for i in g}
    kept = drop_near_duplicates(clashing(docs(spark, texts)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("count", [100, 5_000_000, 10**10])
def test_every_plan_finds_every_link(spark, count, monkeypatch):
    rng = random.Random(count)
    nodes = [rng.getrandbits(64) for _ in range(60)]
    for n in list(nodes):
        for _ in range(rng.randrange(0, 4)):
            n ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
            nodes.append(n)
    signed = sorted({n - (1 << 64) if n >> 63 else n for n in nodes})
    monkeypatch.setattr("pelagos.llm.simhash.segment_plan", lambda n, d, plan=segment_plan(count): plan)
    df = spark.createDataFrame([(n, 1) for n in signed], "fp long, copies long")
    got = {r.fp: r.root for r in near_components(df).collect()}
    want = roots(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert got == {n: r for n, r in want.items() if n != r}


def test_plans_change_with_size():
    assert [len(segment_plan(n)) for n in (100, 5_000_000, 10**10)] == [4, 3, 2]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    pairs = {(min(p), max(p)) for p in links if None not in p}
    want = roots(sorted({n for p in pairs for n in p}), lambda a, b: (a, b) in pairs)
    assert got == {n: r for n, r in want.items() if n != r}


def test_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash_dedup(empty).count() == 0 and drop_near_duplicates(empty).columns == empty.columns
    got = simhash_dedup(docs(spark, ["same words here", "same words here", "same words here"], [None, 9, 9])).collect()
    assert [(r.id, r.component_id) for r in got if r.id is None] == [(None, 9)]
    lone = simhash_dedup(docs(spark, ["only null"], [None])).select(F.col("component_id").isNull().alias("x")).first().x
    assert lone


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    df = clashing(docs(spark, [a, a, b, b, None, ""], [1, 2, 2, 2, None, None]))
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:2]) for r in kept.collect()) == [(-1, ""), (1, "a0"), (2, "b0")]


def test_very_long_texts(spark):
    words = [f"w{i % 977}" for i in range(40_000)]
    got = {r.id: r for r in simhash_dedup(docs(spark, [" ".join(words), "x " + " ".join(words)])).collect()}
    assert int(got[0].fingerprint, 16) == fingerprint(" ".join(words))
    assert {r.component_id for r in got.values()} == {0}
