"""Licence scan and quality network."""

import zlib

import numpy as np
import pytest
from frames import AWKWARD, DOCS, clashing, docs

from pelagos.llm import license_scan, quality_cnn

LICENCES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "bsd": "SPDX-License-Identifier: BSD-3-Clause",
}


def python_scan(text):
    """The same model and templates, one line at a time."""
    model, found = license_scan.trained_model(), []
    for k, line in enumerate((text or "").split("\n")):
        words = license_scan.words_of(line)
        slots = [license_scan.slot_of(g) for g in license_scan.grams_of(words)]
        logits = model.weights[:, slots].sum(1) / max(1, len(slots)) ** 0.5 + model.bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        family = model.families[int(p.argmax())]
        if family == license_scan.UNKNOWN or p.max() < model.threshold:
            continue
        pairs, best = license_scan.counted(words), 0.0
        for t in license_scan.TEMPLATES[family]:
            own = license_scan.counted(license_scan.words_of(t))
            shared = len(own & pairs)
            best = max(best, shared / len(own), shared / len(pairs) if len(pairs) >= 6 else 0.0)
        if best >= license_scan.CONFIRMED:
            found.append((k, family, round(float(p.max()), 9), round(best, 9)))
    return found


def test_licences(spark):
    texts = [*AWKWARD, *(f"Some prose first.\n{v}\nthe end" for v in LICENCES.values()), *license_scan.TALK, "\n".join(LICENCES.values())]
    texts += ["word license " * 5000, "x\n" * 3000 + LICENCES["mit"]]
    got = {}
    for r in license_scan.scan_licences(clashing(docs(spark, texts))).collect():
        got.setdefault(r.id, []).append((r.paragraph, r.family, round(r.probability, 9), round(r.similarity, 9)))
    want = {i: own for i, t in enumerate(texts) if (own := python_scan(t))}
    assert {i: sorted(v) for i, v in got.items()} == want
    for i, family in enumerate(LICENCES, len(AWKWARD)):
        assert [f[1] for f in want[i]] == [family]
    assert not any(i in want for i in range(len(AWKWARD) + len(LICENCES), len(AWKWARD) + len(LICENCES) + len(license_scan.TALK)))


def test_licences_in_long_and_across_lines(spark):
    rng = np.random.default_rng(5)
    other = lambda n: " ".join(rng.choice(["river", "house", "green", "walk", "long", "the", "of", "and"], n))
    texts, want = [], {}
    for family, notice in LICENCES.items():
        for before in (0, 3, 250, 493, 600):
            want[len(texts)] = [(0, family)]
            texts.append(f"{other(before)} {notice} {other(500 - min(before, 490))}")
    for family in ("apache-2.0", "mit", "cc-by-nc", "gpl"):
        words = LICENCES[family].split()
        for around in (0, 200):
            half = len(words) // 2
            want[len(texts)] = [(2 if family == "gpl" and around else 1, family)]  # a window of its second line is enough alone
            texts.append(f"{other(30)}\n{other(around)} {' '.join(words[:half])}\n{' '.join(words[half:])} {other(around)}\nend")
    texts += [other(500), f"{other(200)} {' '.join(license_scan.TALK)} {other(200)}", "\n".join(license_scan.TALK), "license\n\nlicense"]
    got = {}
    for r in license_scan.scan_licences(docs(spark, texts)).collect():
        got.setdefault(r.id, []).append((r.paragraph, r.family))
    assert got == want


def test_cut_templates_are_found_as_without_anchors(spark):
    """Every run of three quarters of every template, alone on a line: anchors decide nothing."""
    texts = []
    for template in (t for own in license_scan.TEMPLATES.values() for t in own):
        words = template.split()
        size = max(3, len(words) * 3 // 4)
        texts += [" ".join(words[b : b + size]) for b in range(len(words) - size + 1)]
    got = {}
    for r in license_scan.scan_licences(docs(spark, texts)).where("similarity >= 0.7").collect():
        got.setdefault(r.id, []).append((r.paragraph, r.family))
    want = {i: [f[:2] for f in own] for i, t in enumerate(texts) if (own := python_scan(t))}
    assert {i: own for i, own in got.items() if i in want} == want
    assert len(want) > 0.75 * len(texts)


def test_a_confirmed_paragraph_holds_an_anchor():
    chosen = set(license_scan.anchors())
    for template in (t for own in license_scan.TEMPLATES.values() for t in own):
        own = license_scan.counted(license_scan.words_of(template))
        free = [g for g in own if not chosen & set(g.split())]
        assert len(free) < 0.7 * len(own) and len(free) < 0.7 * license_scan.LEAST_BIGRAMS, template
    assert license_scan.held_out_report()["threshold"] > 0.5


def test_licences_of_null_ids_and_repeated_rows(spark):
    got = license_scan.scan_licences(docs(spark, [LICENCES["mit"]] * 3 + [None], [4, 4, None, None])).collect()
    assert sorted((r.id or -1, r.family) for r in got) == [(-1, "mit"), (4, "mit"), (4, "mit")]


def test_licence_plan_has_no_python(spark):
    plan = license_scan.scan_licences(docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1].split("LogicalRDD")[0].replace("RoundRobin", "")[:200]


def test_licence_empty_table(spark):
    assert license_scan.scan_licences(spark.createDataFrame([], DOCS)).count() == 0


def prose(rng, bad):
    words = [rng.choice(["the", "of", "and", "river", "house", "green", "walk", "long"]) for _ in range(rng.integers(3, 200))]
    if bad:
        words = [w + "***" for w in words] if rng.random() < 0.5 else [w for w in words for _ in range(6)]
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(2)
    return [(i, prose(rng, i % 4 == 0), int(i % 4 != 0)) for i in range(400)]


def test_quality(spark, labelled):
    texts = [t for _, t, _ in labelled]
    df = clashing(docs(spark, texts))
    labels = spark.createDataFrame([(i, q) for i, _, q in labelled] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality_cnn.fit(df, labels, max_rows=300)
    rows = quality_cnn.classify(df, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [(r.predicted, labelled[r.id][2]) for r in rows if r.held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    kept = quality_cnn.drop_low_quality(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.id for r in rows if r.predicted}
    again = quality_cnn.classify(docs(spark, [*AWKWARD, texts[0] * 400]), model).collect()
    assert all(0 <= r.score <= 1 for r in again)


def test_scores_do_not_depend_on_the_batch(labelled):
    net = quality_cnn.new_net(3)
    texts = [t.encode() for _, t, _ in labelled[:40]] + [b"", b"\0" * 3000, b"z" * 5000]
    alone = np.concatenate([quality_cnn.scores(net, [t]) for t in texts])
    np.testing.assert_allclose(quality_cnn.scores(net, texts), alone, rtol=1e-5)


def test_pooling_matches_a_plain_loop():
    net = quality_cnn.new_net(5)
    text = b"some some some words to look at, some" * 40
    padded = np.frombuffer(text + b"\0" * 64, np.uint8)
    rows = [sum(net.embed[padded[t + j]] @ net.kernel[j] for j in range(quality_cnn.WIDTH)) for t in range(len(text))]
    np.testing.assert_allclose(quality_cnn.pooled(net, [text])[0, : quality_cnn.FILTERS], np.maximum(np.max(rows, 0), rows_of_padding(net)), rtol=1e-4)


def rows_of_padding(net):
    return sum(net.embed[0] @ net.kernel[j] for j in range(quality_cnn.WIDTH))


def test_gradients():
    net = quality_cnn.new_net(1)
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    texts, labels = [b"abc abc abc abc", b"something else!!", b""], np.array([1.0, 0.0, 1.0], np.float32)
    grads = quality_cnn._gradients(net, texts, labels)

    def loss():
        s = np.clip(quality_cnn.scores(net, texts), 1e-9, 1 - 1e-9)
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        if abs(g[at]) < 1e-3:
            continue
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.15)


def test_one_class_gives_the_rate(spark):
    df = docs(spark, ["a", "b"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_cnn.fit(df, none) == 0.5
    model = quality_cnn.fit(df, spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, quality int"))
    assert model > 0.5 and {r.score for r in quality_cnn.classify(df, model).collect()} == {model}
    assert quality_cnn.classify(spark.createDataFrame([], DOCS), model).count() == 0
