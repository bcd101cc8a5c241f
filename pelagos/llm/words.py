"""Word hashes of whole Arrow batches: the vectorised base of the window and shingle operators.

A batch's words are split and dictionary-encoded by Arrow, so each distinct word of a batch is hashed once and the
windows of all documents come from a few numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd base of the polynomial hash over words, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def split_words(texts: pa.Array, lower_words: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch, end to end, and where each text's words begin (with the end last).

    ``lower_words`` lower-cases the texts and takes maximal runs of letters and digits as words instead.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower_words:
        texts = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")
    trimmed = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(trimmed)
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    empty = np.asarray(pc.equal(pc.binary_length(trimmed), 0)).astype(bool)
    words = pc.list_flatten(lists)
    if empty.any():  # an empty text splits into one empty word
        keep = np.ones(len(words), bool)
        keep[(np.cumsum(counts) - counts)[empty & (counts > 0)]] = False
        words = words.filter(pa.array(keep))
        counts[empty] = 0
    return words, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    own = coded.dictionary.cast(pa.large_binary()).to_pylist()
    each = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in own), np.uint64, len(own))
    return each[np.asarray(coded.indices)]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of ``width`` neighbours from each position, by doubling; shorter than the input by width - 1."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    done, span = None, 0
    block, block_span, block_power = hashes, 1, BASE
    with np.errstate(over="ignore"):
        left = width
        while left:
            if left & 1:
                if done is None:
                    done, span = block, block_span
                else:
                    size = len(hashes) - span - block_span + 1
                    done = done[:size] * block_power + block[span : span + size]
                    span += block_span
            left >>= 1
            if left:
                size = len(block) - block_span
                block = block[:size] * block_power + block[block_span : block_span + size]
                block_span, block_power = 2 * block_span, block_power * block_power
        # the last mix spreads the low bits, which depend on the last words most, over the whole value
        done = done ^ (done >> np.uint64(31))
        done = done * np.uint64(0xBF58476D1CE4E5B9)
    return done ^ (done >> np.uint64(29))


def window_starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, among all words, where a window of ``width`` words of one text begins, and the text of each."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(first, counts) + bounds[:-1][text], text


def bounded(batches: Iterator[pa.RecordBatch], text: int, rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts, in column ``text``, have at most ``size`` bytes or are a single one."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = min(max(int(np.searchsorted(ends, done + size, "right")), begin + 1), begin + rows, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
