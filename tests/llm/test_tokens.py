"""Byte-level BPE and token counts against the tokenizer libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from frames import AWKWARD, DOCS, clashing, docs

from pelagos.llm.bpe import decode_documents, encode_documents, encoding, safe_parts
from pelagos.llm.token_counts import SegmentCounter, count_tokens, piece_file_counter, segments

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")
TEXTS = [*AWKWARD, "It's 12345 o'clock,  isn't\n\n\tit?  ", "a" * 3000 + " " + "1" * 500, "abc123def " * 900, "'s 't  're\r\n x"]


@pytest.fixture(scope="module")
def enc():
    return encoding(RANKS, P.PATTERN)


def test_parts_are_safe(enc):
    rng = random.Random(3)
    signs = list("ab Z9'\n\t ,.é日-") + ["'s", "  ", "\n\n", "12", "x1"]
    for _ in range(300):
        text = "".join(rng.choices(signs, k=rng.randrange(0, 200)))
        parts = safe_parts(text, rng.randrange(1, 20))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_encode_and_decode(spark, enc):
    made = encode_documents(clashing(docs(spark, TEXTS)), RANKS, P.PATTERN)
    rows = made.collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = enc.encode_ordinary(TEXTS[r.id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.id] or "").encode()).hexdigest()
    back = decode_documents(made, RANKS, P.PATTERN).collect()
    assert all(bytes(r.content).decode() == (TEXTS[r.id] or "") for r in back)


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], DOCS), RANKS, P.PATTERN).count() == 0
    assert count_tokens(spark.createDataFrame([], DOCS), PIECES).count() == 0


@pytest.fixture(scope="module")
def unigram():
    """The library over the same pieces and scores: the file with its model type set to unigram."""
    with open(PIECES, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")


def test_counts_match_the_library(spark, unigram):
    rng = random.Random(9)
    texts = [t for t in TEXTS if t is None or len(t) < 2000]
    texts += ["".join(rng.choices("aeinrst hTé日\n▁😀  ", k=rng.randrange(1, 60))) for _ in range(150)]
    got = {r.id: r.n_tokens for r in count_tokens(clashing(docs(spark, texts)), PIECES).collect()}
    want = {i: len(unigram.encode(t)) if t else 0 for i, t in enumerate(texts)}
    assert got == want


def test_ties_take_the_earlier_start():
    c = SegmentCounter([("a", -1.0), ("aa", -2.0), ("b", -1.0), ("▁", 0.0)], False)
    assert c.count("▁aa") == 2  # "▁", "aa": the piece that begins first wins a tie
    assert c.count("▁zzb") == 3  # neighbouring unknown characters count as one


def plain_viterbi(text, pieces, byte_pieces):
    """Tokens of a text by trying every piece at every place, ties to the piece that begins first."""
    scores, strange = dict(pieces), min(s for _, s in pieces) - 10
    best = [(0.0, 0, False)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            piece = text[begin:end]
            if piece in scores:
                made = (best[begin][0] + scores[piece], best[begin][1] + 1, False)
            elif end - begin == 1:
                more = len(piece.encode()) if byte_pieces else int(not best[begin][2])
                made = (best[begin][0] + strange, best[begin][1] + more, True)
            else:
                continue
            if best[end] is None or made[0] > best[end][0]:
                best[end] = made
    return best[-1][1]


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_counts_match_a_plain_viterbi(byte_pieces):
    rng = random.Random(5)
    for trial in range(60):
        names = {"".join(rng.choices("ab▁é", k=rng.randrange(1, 5))) for _ in range(12)} | {"a"}
        if trial % 2:
            names = {n for n in names if "▁" not in n.lstrip("▁")}
        pieces = [(n, float(-rng.randrange(1, 9))) for n in sorted(names)]
        counter = SegmentCounter(pieces, byte_pieces)
        assert counter.whole == (any("▁" in n.lstrip("▁") for n in names) or (not byte_pieces and "▁" not in names))
        for _ in range(20):
            text = "".join(rng.choices("ab éx", k=rng.randrange(1, 30)))
            got = sum(map(counter.count, segments(text, counter.whole)))
            assert got == plain_viterbi("▁" + text.replace(" ", "▁"), pieces, byte_pieces), (pieces, text)


def test_long_texts_repeated_rows_and_null_ids(spark, unigram):
    long_text = "internationalisation " * 20_000 + "x" * 30_000
    got = sorted((r.id or -1, r.n_tokens) for r in count_tokens(docs(spark, [long_text, "two words", "two words", None], [9, 1, 1, None]), PIECES).collect())
    two = len(unigram.encode("two words"))
    assert got == [(-1, 0), (1, two), (1, two), (9, len(unigram.encode(long_text)))]


def test_segments():
    assert segments("a  b c") == ["▁a", "▁▁b", "▁c"]
    assert segments(" a") == ["▁▁a"]
    assert segments("") == []
    assert piece_file_counter(PIECES).byte_pieces
