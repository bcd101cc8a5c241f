"""Licence scans: a trained paragraph classifier whose predictions a template comparison confirms.

A paragraph is a line.  Besides whole lines, overlapping word windows around the anchors of longer lines are scored, so
that other words of a line do not dilute a notice, and windows across each line break, for notices that are wrapped.  A
whole line counts first, then its likeliest window, then the likeliest one across the break after it; that is reported
as the line where it begins, and only if neither of its sides would be confirmed alone.  Word uni-, bi- and trigrams
are hashed into sparse counts, and a multinomial logistic regression over licence families and an unknown class gives
each line or window a probability per family.  The model is trained on the fixed templates below, on their cuts, joins
and word-level edits, and on sentences that talk about licences without granting one.  The acceptance threshold is
calibrated on templates and sentences that a first fit never saw, which are unknown to it whatever their family: the
lowest one that at most one in twenty of their variants passes; ``held_out_report`` gives precision and recall.  A prediction is reported only if
a template of its family confirms it: enough of the template's bigrams are in the paragraph, or, from six different
bigrams, enough of the paragraph's are in the template.  Bigrams of two frequent words do not count.

Training works on the templates alone (a few thousand short strings, whatever the corpus); scoring is one projection of
built-in functions over the scan, with the weights as a folded literal: no shuffle, no join, no Python worker.

A line without an anchor is skipped, which loses nothing: anchors are words chosen from the templates until, in each of
them, so few bigrams are free of anchors that a confirmed paragraph must hold one that is not (``anchors``).

Edge cases
    null or empty text   no paragraphs, nothing reported
    very long text       every paragraph is scanned, whole and in windows
    several notices      a line reports one of them
    null id              carried through
    repeated rows, ties  every row and every paragraph is reported; of equal probabilities the first family wins
    empty table          empty result of the same columns
    extra columns        ignored by name
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 13
CONFIRMED = 0.7
#: Training rows that must hold an n-gram for it to get a weight.
LEAST_SEEN = 8
#: Words in a window; neighbours overlap by half, and the largest is longer than any template.
WINDOWS = (4, 8, 16, 32, 64)
UNKNOWN = "unknown"

#: Bigrams that a paragraph must have for its share in a template to count.
LEAST_BIGRAMS = 6
#: Frequent words.
FREQUENT = (
    "a all an and any are as at be by can for have in is it may no not of on or other out that the this to under use with "
    "without you your"
).split()

#: Public notices and openings of common licences, lower case, by family.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        "spdx-license-identifier apache-2.0",
    ),
    "mit": (
        "released under the mit license",
        "this project is licensed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "spdx-license-identifier mit",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program",
        "released under the gnu gpl version 2 license",
        "spdx-license-identifier gpl-3.0-or-later",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "spdx-license-identifier lgpl-2.1-only",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd 3-clause license",
        "use of this source code is governed by a bsd-style license that can be found in the license file",
        "spdx-license-identifier bsd-3-clause",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v. 2.0",
        "licensed under the mozilla public license version 2.0",
        "spdx-license-identifier mpl-2.0",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
        "licensed under cc by-sa 4.0 license",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
    ),
    "cc-by-nc": (
        "licensed under cc by-nc 4.0",
        "licensed under cc by-nc-sa 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    ),
    "public-domain": (
        "this work is dedicated to the public domain under cc0 1.0 universal license",
        "this is free and unencumbered software released into the public domain",
        "spdx-license-identifier cc0-1.0",
    ),
    "proprietary": (
        "copyright all rights reserved",
        "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher",
        "confidential and proprietary unauthorized copying of this file via any medium is strictly prohibited without permission",
    ),
}

#: Sentences that hold anchors and grant nothing.
TALK = (
    "the driver showed a valid license at the border",
    "fishing license fees rise again next year",
    "she asked permission to leave the room early",
    "the warranty on the old car ran out in march",
    "copyright law is a hard subject for students",
    "the board discussed which license the project should choose",
    "he renewed his driving license and his passport",
    "the domain name expired and the site went dark",
    "permission slips are due on friday",
    "a licensed electrician must inspect the wiring",
    "the restaurant lost its liquor license",
    "the redistribution of wealth was debated in parliament",
    "we compare the terms of several software licenses in this article",
    "questions about the license should go to the legal team",
)


def words_of(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9.+-]+", " ", text.lower()).split(" ") if w.strip(".")]


def _trimmed(word: str) -> str:
    return word.strip(".")


def grams_of(words: list[str], sizes: tuple[int, ...] = (1, 2, 3)) -> list[str]:
    words = [_trimmed(w) for w in words]
    return [" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)]


def counted(words: list[str]) -> set[str]:
    """Bigrams that count in a comparison: those with a word that is not frequent."""
    return {g for g in grams_of(words, (2,)) if not set(FREQUENT).issuperset(g.split(" "))}


def _free(template: str, chosen: set[str]) -> list[str]:
    """Bigrams of a template without a chosen word."""
    return [g for g in counted(words_of(template)) if not chosen & set(g.split(" "))]


@functools.lru_cache(maxsize=4)
def anchors(confirmed: float = CONFIRMED) -> tuple[str, ...]:
    """Words of which every paragraph that a template can confirm holds one.

    To be confirmed takes ``confirmed`` of the template's bigrams, or of LEAST_BIGRAMS and more in the paragraph.  Words
    are added, those first that free most bigrams of the templates still open, until no template has that many without
    one.
    """
    chosen: set[str] = set()
    templates = [t for own in TEMPLATES.values() for t in own]
    need = {t: min(math.ceil(confirmed * len(_free(t, set())) - 1e-9), math.ceil(confirmed * LEAST_BIGRAMS - 1e-9)) for t in templates}
    while open_ := [t for t in templates if len(_free(t, chosen)) >= need[t]]:
        gain = Counter(w for t in open_ for g in _free(t, chosen) for w in set(g.split()))
        chosen.add(max((w for w in gain if w not in FREQUENT), key=lambda w: (len(w) > 2, gain[w], w)))
    return tuple(sorted(chosen))


def _trie_pattern(words: tuple[str, ...]) -> str:
    """A pattern that matches where one of ``words`` begins a word, shared beginnings written once."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def written_out(node: dict) -> str:
        if "" in node:
            return ""
        parts = [re.escape(c) + written_out(rest) for c, rest in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return rf"(?<![a-z0-9+-]){written_out(tree)}"


def slot_of(gram: str) -> int:
    value = xxhash.xxh64_intdigest(gram.encode(), 42)
    return value % SLOTS  # SLOTS divides 2**64, so this agrees with pmod of the signed hash


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]
    weights: np.ndarray  # family and unknown last, slot
    bias: np.ndarray
    threshold: float


def _variants(rng: np.random.Generator) -> list[tuple[str, str, int]]:
    """(text, family, source): templates with edges cut, words dropped and other words around them; talk and noise as unknown."""
    filler = sorted({w for t in TALK for w in t.split()})
    noise = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(400)]
    made = []

    def around(words: list[str], most: int) -> str:
        pool = filler if rng.random() < 0.5 else noise
        before, after = ([pool[i] for i in rng.integers(0, len(pool), rng.integers(0, most + 1))] for _ in "ab")
        return " ".join([*before, *words, *after])

    for family, templates in TEMPLATES.items():
        for source, template in enumerate(templates):
            words = template.split()
            made += [(template, family, source)] * 4
            for _ in range(20):
                size = max(4, int(len(words) * rng.uniform(0.7, 1)))
                begin = int(rng.integers(0, len(words) - size + 1)) if size < len(words) else 0
                cut = words[begin : begin + size] if rng.random() < 0.5 else list(words)
                if len(cut) > 8 and rng.random() < 0.5:
                    del cut[int(rng.integers(0, len(cut)))]
                made.append((around(cut, 4), family, source))
    for source, text in enumerate(TALK):
        made += [(around(text.split(), 3), UNKNOWN, source) for _ in range(25)]
    for i in range(500):
        some = [filler[i] for i in rng.integers(0, len(filler), 6)] + [noise[i] for i in rng.integers(0, 400, 6)]
        made.append((" ".join(rng.permutation(some)), UNKNOWN, i))
    return made


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: Of the templates of a family and of the sentences, every so many is kept from the first fit, the last of each first.
HELD_OUT = 3
#: Share of the held-out variants, whose sources the fit never saw, that may pass the threshold.
STRANGERS = 0.05


class _Training:
    """Variants as sparse rows, the fit on all of them, and the threshold from a fit without the held-out sources."""

    def __init__(self, seed: int):
        made = _variants(np.random.default_rng(seed))
        self.families = (*TEMPLATES, UNKNOWN)
        slots = [[slot_of(g) for g in grams_of(words_of(t))] for t, _, _ in made]
        seen = Counter(s for own in slots for s in set(own))
        self.used = sorted(s for s, n in seen.items() if n >= LEAST_SEEN)
        column = {s: i for i, s in enumerate(self.used)}
        self.x = np.zeros((len(made), len(self.used)))
        for row, own in enumerate(slots):
            for s in own:
                if s in column:
                    self.x[row, column[s]] += 1 / max(1, len(own)) ** 0.5
        self.labels = np.array([self.families.index(f) for _, f, _ in made])
        last = {f: len(own) for f, own in [*TEMPLATES.items(), (UNKNOWN, len(TALK) * [0])]}
        self.held = np.array([(last[f] - 1 - s) % HELD_OUT == 0 for _, f, s in made])
        weights, bias = self.fit(~self.held)
        unknown = len(self.families) - 1
        likely = _softmax(self.x @ weights + bias)
        best, top = likely.argmax(1), likely.max(1)
        strange = np.where(best[self.held] != unknown, top[self.held], 0)  # of no source that the fit knows
        self.threshold = float(np.quantile(strange, 1 - STRANGERS))
        found = (best != unknown) & (top >= self.threshold)
        known = ~self.held & (self.labels != unknown)
        right = found & known & (best == self.labels)
        self.report = {"precision": right.sum() / max(1, found.sum()), "recall": right.sum() / max(1, known.sum())}

    def fit(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.x[rows], np.eye(len(self.families))[self.labels[rows]]
        weights, bias = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        for _ in range(200):
            error = (_softmax(x @ weights + bias) - y) / len(y)
            weights -= 20.0 * (x.T @ error + 2e-5 * weights)
            bias -= 2.0 * error.sum(0)
        return weights, bias


@functools.lru_cache(maxsize=1)
def _training(seed: int = 11) -> _Training:
    return _Training(seed)


def held_out_report() -> dict[str, float]:
    """threshold, recall over variants of known templates, and precision over these and strangers, before confirmation."""
    return {"threshold": _training().threshold, **{k: float(v) for k, v in _training().report.items()}}


@functools.lru_cache(maxsize=1)
def trained_model() -> LicenceModel:
    """Multinomial logistic regression over hashed n-grams of all variants, and the calibrated threshold."""
    made = _training()
    weights, bias = made.fit(np.ones(len(made.labels), bool))
    whole = np.zeros((len(made.families), SLOTS))
    whole[:, made.used] = np.round(weights.T, 6)
    return LicenceModel(made.families, whole, np.round(bias, 6), made.threshold)


def _numbers(values: np.ndarray, kind: str) -> Column:
    """A literal array, folded once when the query is planned."""
    return F.split(F.lit(",".join(f"{v:.12g}" for v in values)), ",").cast(f"array<{kind}>")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are evaluated once: what a generator returns is not inlined where it is used."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _grams(words: Column, n: int) -> Column:
    """n-grams of a word array, joined by a space, repeats included."""
    last = F.size(words) - n + 1
    some = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, some).otherwise(F.array().cast("array<string>"))


def _words(line: Column) -> Column:
    """Words of a line, without the points at their ends."""
    plain = F.regexp_replace(F.lower(line), r"[^a-z0-9.+-]+", " ")
    return F.filter(F.split(F.regexp_replace(plain, r"(?<![^ ])\.+|\.+(?![^ ])", ""), " "), lambda w: w != "")


def _anchor_pattern() -> str:
    return _trie_pattern(anchors())


def _window(kind: int, words: Column, tail: Column) -> Column:
    """kind: 0 a whole line, 1 a part of one, 2 the last ``tail`` words of a line and the first of the next."""
    return F.struct(F.lit(kind).alias("kind"), words.alias("words"), tail.alias("tail"))


def _inside(size: int) -> Column:
    """The windows of a longer line that hold an anchor."""
    step = size // 2
    starts = F.transform("anchors", lambda p: F.array(p - p % step, F.greatest(p - p % step - step, F.lit(0))))
    cut = F.transform(F.array_distinct(F.flatten(starts)), lambda s: _window(1, F.slice("words", s + 1, F.lit(size)), F.lit(0)))
    return F.when(F.size("words") > size, cut).otherwise(F.array())


def _across(size: int) -> Column:
    """The window around the break after a line, if it holds an anchor."""
    half = size // 2
    tail = F.slice("words", F.greatest(F.size("words") - half + 1, F.lit(1)), F.lit(half))
    words = F.concat(tail, F.slice("next", F.lit(1), F.lit(half)))
    holds = F.exists(words, lambda w: w.rlike(_anchor_pattern()))
    return F.when((F.size("words") > 0) & (F.size("next") > 0) & holds, F.array(_window(2, words, F.size(tail)))).otherwise(F.array())


def _each(lines: DataFrame, **made) -> DataFrame:
    """``lines`` with each struct of found replaced by what the functions make of it, evaluated once."""
    new = F.transform("old", lambda w: F.struct(*(f(w).alias(n) for n, f in made.items())))
    return _once(lines.withColumnRenamed("found", "old"), found=new).drop("old")


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confirmed: float = CONFIRMED
) -> DataFrame:
    """One row per confirmed paragraph: id, paragraph (line number from 0), family, probability and similarity."""
    model = trained_model()
    used = np.flatnonzero(model.weights.any(0))
    place = np.zeros(SLOTS, np.int64)  # of a slot among those with weights, from 1; 0 for none
    place[used] = np.arange(1, len(used) + 1)
    size = len(model.families)
    place, table, bias = _numbers(place, "int"), _numbers(model.weights[:, used].T.ravel(), "double"), _numbers(model.bias, "double")

    anchored = lambda text: F.lower(text).rlike(_anchor_pattern())
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(anchored(F.col("text")))
    rows = _once(rows, lines=F.split("text", "\n")).select("id", "lines")
    pairs = F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.get("lines", i + 1).alias("after")))
    lines = rows.select("id", F.posexplode(pairs).alias("paragraph", "at")).select("id", "paragraph", "at.line", "at.after")
    lines = lines.where(anchored(F.concat_ws(" ", "line", "after"))).withColumn("whole", anchored(F.col("line")))
    lines = _once(lines, words=_words(F.col("line")), next=_words(F.coalesce("after", F.lit("")))).drop("line", "after")
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(_anchor_pattern()))
    lines = _once(lines, anchors=places)
    whole = F.when(F.col("whole"), F.array(_window(0, F.col("words"), F.lit(0)))).otherwise(F.array())
    cuts = [part(size) for part in (_inside, _across) for size in WINDOWS]
    lines = _once(lines, found=F.concat(whole, *cuts)).select("id", "paragraph", "found").where(F.size("found") > 0)

    same = {n: (lambda w, n=n: w[n]) for n in ("kind", "tail", "words", "pairs", "logits", "best", "probability")}
    keep = lambda *names: {n: same[n] for n in names}
    lines = _each(lines, **keep("kind", "tail", "words"), pairs=lambda w: _grams(w["words"], 2), triples=lambda w: _grams(w["words"], 3))
    place_of = lambda g: F.element_at(place, (F.pmod(F.xxhash64(g), F.lit(SLOTS)) + 1).cast("int"))
    seen = lambda w: F.filter(F.transform(F.concat(w["words"], w["pairs"], w["triples"]), place_of), lambda i: i > 0)
    count = lambda w: F.size(w["words"]) + F.size(w["pairs"]) + F.size(w["triples"])
    lines = _each(lines, **keep("kind", "tail", "words", "pairs"), seen=seen, n=count)
    row_of = lambda i: F.slice(table, (i - 1) * size + 1, F.lit(size))
    start = F.array_repeat(F.lit(0.0), size)
    totals = lambda w: F.aggregate(w["seen"], start, lambda s, i: F.zip_with(s, row_of(i), lambda x, y: x + y))
    share = lambda w: F.sqrt(F.greatest(w["n"], F.lit(1)).cast("double"))
    lines = _each(lines, **keep("kind", "tail", "words", "pairs"), totals=totals, share=share)
    logits = lambda w: F.zip_with(w["totals"], bias, lambda x, b: x / w["share"] + b)
    lines = _each(lines, **keep("kind", "tail", "words", "pairs"), logits=logits)
    top = lambda w: F.array_max(w["logits"])
    lines = _each(lines, **keep("kind", "tail", "words", "pairs", "logits"), top=top)
    best = lambda w: F.array_position(w["logits"], w["top"]).cast("int")
    total = lambda w: F.aggregate(F.transform(w["logits"], lambda x: F.exp(x - w["top"])), F.lit(0.0), lambda s, x: s + x)
    lines = _each(lines, **keep("kind", "tail", "words", "pairs"), best=best, probability=lambda w: 1 / total(w))
    likely = F.filter("old", lambda w: (w["best"] < size) & (w["probability"] >= model.threshold))  # unknown comes last
    lines = _once(lines.withColumnRenamed("found", "old"), found=likely)
    lines = lines.drop("old").where(F.size("found") > 0)

    templates = F.lit([[sorted(counted(words_of(t))) for t in own] for own in TEMPLATES.values()])
    frequent = rf"^(?:{'|'.join(FREQUENT)}) (?:{'|'.join(FREQUENT)})$"

    def similarity(best: Column, pairs: Column) -> Column:
        pairs = F.array_distinct(F.filter(pairs, lambda g: ~g.rlike(frequent)))

        def likeness(own: Column) -> Column:
            shared = F.size(F.array_intersect(pairs, own))
            part = F.when(F.size(pairs) >= LEAST_BIGRAMS, shared / F.size(pairs)).otherwise(0.0)
            return F.greatest(shared / F.size(own), part)

        return F.array_max(F.transform(F.element_at(templates, best), likeness))

    before = lambda w: F.slice(w["pairs"], F.lit(1), F.greatest(w["tail"] - 1, F.lit(0)))
    after = lambda w: F.slice(w["pairs"], w["tail"] + 1, F.size(w["pairs"]))

    def side(w: Column) -> Column:
        """The greater similarity of the two sides of a break."""
        return F.when(w["kind"] == 2, F.greatest(similarity(w["best"], before(w)), similarity(w["best"], after(w)))).otherwise(0.0)

    def joins(w: Column) -> Column:
        """Whether both sides of a break, or the words at it, are from templates of the family."""
        own = F.flatten(F.element_at(templates, w["best"]))
        at = F.array_contains(own, F.get(w["pairs"], w["tail"] - 1))
        return (w["kind"] < 2) | at | (F.arrays_overlap(before(w), own) & F.arrays_overlap(after(w), own))

    like = lambda w: similarity(w["best"], w["pairs"])
    lines = _each(lines, **keep("kind", "best", "probability"), similarity=like, side=side, joins=joins)
    lines = _once(lines, alone=F.transform(F.filter("found", lambda w: w["side"] >= confirmed), lambda w: w["best"]))
    split = lambda w: (w["kind"] < 2) | ~F.array_contains("alone", w["best"])
    sure = F.filter("found", lambda w: (w["similarity"] >= confirmed) & w["joins"] & split(w))
    order = F.transform(sure, lambda w: F.struct(w["kind"], (-w["probability"]).alias("p"), (-w["similarity"]).alias("s"), w["best"]))
    first = _once(lines, hit=F.array_min(order)).where(F.col("hit").isNotNull())
    family = F.element_at(F.lit(list(model.families)), F.col("hit.best")).alias("family")
    return first.select("id", "paragraph", family, (-F.col("hit.p")).alias("probability"), (-F.col("hit.s")).alias("similarity"))
