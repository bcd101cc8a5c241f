"""Exact dedup and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from frames import AWKWARD, DOCS, clashing, docs

from pelagos.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from pelagos.llm.substring_dedup import batch_windows, substring_dedup


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_matches_brute_force(spark, digest_all):
    texts = [*AWKWARD, "same  text", "same text", "same\ttext", "a" * 70 + "b", "a" * 70 + "c", None, ""]
    got = exact_dedup(clashing(docs(spark, texts)), digest_all=digest_all).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(normal(t), []).append(i)
    assert len(got) == len(texts)
    for r in got:
        own = groups[normal(texts[r.id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.id == min(own))
        if digest_all or len(own) > 1:
            assert r.text_sha256 == hashlib.sha256(normal(texts[r.id]).encode()).hexdigest()


def test_drop_keeps_columns_and_one_of_each(spark):
    df = clashing(docs(spark, ["a", "a ", "a", "b", "b", None, ""], [3, 1, 1, 5, None, None, None]))
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id == 5) == [(5, "b")]
    assert sum(1 for r in kept.collect() if normal(r.text).strip() == "a") == 2  # "a " and "a" differ


def test_repeated_rows_leave_one(spark):
    assert [r.doc_id for r in drop_exact_duplicates(docs(spark, ["q"] * 4, [2, 2, 2, 7])).collect()] == [2]


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_exact_agrees_with_and_without_broadcast(spark, monkeypatch, few):
    from pelagos.llm import exact_dedup as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", few)
    long_text = "word " * 200_000
    texts = [long_text, long_text + "x", long_text, "a b", "a  b", "unique", None, "", "c" * 99 + "1", "c" * 99 + "2"]
    df = docs(spark, texts, [9, 8, 7, None, 3, 2, None, None, 5, 5])
    for every in (True, False):
        got = sorted((r.id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup(df, digest_all=every).collect())
        want = [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (5, 5, 1, True), (5, 5, 1, True)]
        assert got == sorted([*want, (7, 7, 2, True), (8, 8, 1, True), (9, 7, 2, False)])
    kept = sorted((r.doc_id or -1, len(r.text or "")) for r in drop_exact_duplicates(df).collect())
    assert [i for i, _ in kept] == [-1, -1, 2, 3, 5, 5, 7, 8]


def test_only_survivors_are_hashed_in_full(spark):
    from pelagos.llm.exact_dedup import _Levels

    found = _Levels(docs(spark, ["aa", "bb", "bb", "ccc", "x" * 80 + "1", "x" * 80 + "2"]), "doc_id", "text", 64)
    assert sorted(r.id for r in found.alike.collect()) == [0, 1, 2, 4, 5]
    assert sorted(r.id for r in found.hashed.collect()) == [1, 2, 4, 5]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup(empty).count() == 0
    assert drop_exact_duplicates(empty).columns == empty.columns
    assert substring_dedup(empty).count() == 0


def brute(texts, ids, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    for k in order:
        for i in range(len(words[k]) - width + 1):
            first.setdefault(tuple(words[k][i : i + width]), (ids[k], i))
    made = {}
    for k in order:
        gone = set()
        for i in range(len(words[k]) - width + 1):
            if first[tuple(words[k][i : i + width])] != (ids[k], i):
                gone |= set(range(i, i + width))
        made[ids[k]] = (len(words[k]), len(gone), " ".join(w for i, w in enumerate(words[k]) if i not in gone))
    return made


@pytest.mark.parametrize(("width", "bucket_bytes"), [(5, 1 << 20), (20, 2000), (1, 500)])
def test_substring_matches_brute_force(spark, width, bucket_bytes):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(30)]
    passage = rng.choices(vocabulary, k=60)
    texts = list(AWKWARD)
    for _ in range(40):
        own = rng.choices(vocabulary, k=rng.randrange(0, 90))
        if rng.random() < 0.6:
            b = rng.randrange(0, 30)
            own[rng.randrange(0, len(own) + 1) : 0] = passage[b : b + rng.randrange(1, 60)]
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    texts.append(" ".join(["again"] * 300))
    ids = rng.sample(range(1000), len(texts))
    want = brute(texts, ids, width)
    got = substring_dedup(clashing(docs(spark, texts, ids)), width=width, bucket_bytes=bucket_bytes).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want
    for r in got:
        assert sum(s.end - s.begin for s in r.removed) == r.n_removed


def test_substring_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = substring_dedup(docs(spark, [text, text, text], [4, 4, None])).collect()
    assert sorted((r.id or -1, r.n_removed) for r in got) == [(-1, 25), (4, 0), (4, 0)]


def test_substring_ids_of_other_types_and_long_texts(spark):
    rng = random.Random(3)
    passage = rng.choices([f"w{i}" for i in range(500)], k=80)
    texts = [" ".join(rng.choices([f"v{i}" for i in range(5000)], k=60_000)), " ".join(passage), " ".join(["x", *passage]), None]
    texts[0] += " " + texts[1]
    want = {i: v[:2] for i, v in brute(texts, [0, 1, 2, 3], 20).items()}
    for kind in ("string", "int", "decimal(5,1)", "date"):
        made = docs(spark, texts).selectExpr("date_add(date'2020-01-01', int(doc_id)) AS d", "*")
        ids = made.d if kind == "date" else made.doc_id.cast(kind)
        got = substring_dedup(made.select(ids.alias("doc_id"), "text")).collect()
        assert [(r.n_words, r.n_removed) for r in sorted(got, key=lambda r: r.id)] == [want[i] for i in range(4)], kind


def test_intervals_without_broadcast(spark, monkeypatch):
    from pelagos.llm import substring_dedup as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    text = " ".join(f"w{i}" for i in range(25))
    got = substring_dedup(docs(spark, [text, "a " + text, None, ""], [4, 5, 6, None])).collect()
    assert sorted((r.id or -1, r.n_removed) for r in got) == [(-1, 0), (4, 0), (5, 25), (6, 0)]


def test_batches_pass_a_hash_on_once():
    text = " ".join(f"w{i}" for i in range(60))
    again = batch_windows(pa.array(range(400)), np.full(400, 7), pa.array([text] * 400), 20)[4]
    assert len(again) == 400 * 41 and (~again).sum() == 41


def test_repeated_rows_are_read_once_a_batch():
    text = " ".join(f"w{i}" for i in range(60))
    _, _, row, _, again = batch_windows(pa.array([1] + [2] * 399), np.full(400, 7), pa.array([text] * 400), 20)
    assert len(again) == 2 * 41 and again.sum() == 41
    assert set(row[again].tolist()) == {1}
