"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a document feed two banks of learned filters.  The first bank slides over embedded bytes, six at a time;
as a filter over embeddings is a sum of one table row per byte, it runs as table lookups.  The second bank slides over
self-match planes: plane ``l`` counts, within 32 bytes, the bytes that equal the byte ``l`` places on.  Both are
max-pooled over overlapping chunks that cover the whole document, the chunk maxima over the document, and a small dense
layer turns them into one probability.

Training is Adam on a bounded sample of labelled rows, ``max_rows`` of up to ``max_text_bytes``, half of each class where there are enough;
the output bias is then moved back to the label frequencies of all labelled rows.  The sample is taken by a hash of the
id and the seed is fixed, so the model is the same on every run.  Only the text enters a score.

Edge cases
    null or empty text   scored as a document of padding, between 0 and 1 like any other
    very long text       all chunks are scored
    null id              scored; never held out, never learnt from
    one class or none    every score is the smoothed label frequency
    conflicting labels   a document whose label rows disagree is not learnt from
    null label           not learnt from
    repeated rows, ties  every row is scored on its own; at most ``max_rows`` texts are learnt from
    empty table          empty result of the same columns
    extra columns        ignored by name, or carried through by ``drop_low_quality``
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm.words import bounded
from pelagos.scratch import written

MAX_ROWS = 2000
EPOCHS = 12
WIDTH, EMBED, FILTERS = 6, 6, 16
LAGS, MATCH_FILTERS = np.arange(2, 22), 8
HIDDEN = 16
#: Bytes of a chunk; neighbours overlap by half.
CHUNK = 2048
STRIDE = CHUNK // 2
#: Longer labelled texts are not learnt from, so at most MAX_ROWS times as much reaches the driver.
MAX_TEXT_BYTES = 1 << 16
_PAD = 32  # at least WIDTH, the largest lag, and the span of a match count
_PIECE = 32  # chunks at a time
_ROWS = 512


@dataclass
class Net:
    embed: np.ndarray  # 256, EMBED
    kernel: np.ndarray  # WIDTH, EMBED, FILTERS
    match: np.ndarray  # lags, MATCH_FILTERS
    pool_bias: np.ndarray  # FILTERS + MATCH_FILTERS
    dense: np.ndarray  # FILTERS + MATCH_FILTERS, HIDDEN
    dense_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, f) for f in self.__dataclass_fields__]


def new_net(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    f = FILTERS + MATCH_FILTERS
    shapes = [(256, EMBED), (WIDTH, EMBED, FILTERS), (len(LAGS), MATCH_FILTERS), (f,), (f, HIDDEN), (HIDDEN,), (HIDDEN,), (1,)]
    scale = [0.5, 0.3, 0.3, 0.0, 0.25, 0.0, 0.3, 0.0]
    return Net(*(s * rng.standard_normal(shape, np.float32) for s, shape in zip(scale, shapes, strict=True)))


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, each padded with zeros to a multiple of 8; where half chunks begin; the text of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    room = (sizes + _PAD + 7) // 8 * 8
    begin = np.cumsum(room) - room
    buf = np.zeros(room.sum() + _PAD, np.uint8)
    for b, t in zip(begin.tolist(), texts, strict=True):
        buf[b : b + len(t)] = np.frombuffer(t, np.uint8)
    chunks = np.maximum(1, -(-sizes // STRIDE))
    text = np.repeat(np.arange(len(texts)), chunks)
    starts = begin[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    return buf, starts, text


def _match_counts(buf: np.ndarray) -> np.ndarray:
    """For each 8 bytes and lag, how many of the last 32 bytes equal the byte ``lag`` places on, over 32."""
    size = len(buf) - _PAD
    own, words = buf[:size], np.empty((size // 8, len(LAGS)), np.uint8)
    for k, lag in enumerate(LAGS.tolist()):
        words[:, k] = np.bitwise_count(((own == buf[lag : lag + size]) & (own != 0)).view(np.uint64))
    total = words.copy()
    for back in (1, 2, 3):
        total[back:] += words[:-back]
    return total.astype(np.float32) * np.float32(1 / 32)


def _tables(net: Net) -> np.ndarray:
    return np.einsum("be,wef->wbf", net.embed, net.kernel).astype(np.float32)


def _convolved(tables: np.ndarray, buf: np.ndarray, begin: int, end: int) -> np.ndarray:
    made = np.take(tables[0], buf[begin:end], axis=0)
    for j in range(1, WIDTH):
        made += np.take(tables[j], buf[begin + j : end + j], axis=0)
    return made


def pooled(net: Net, texts: list[bytes]) -> np.ndarray:
    """Maxima of every filter over every text: of each half chunk, of each chunk (two neighbouring halves), of the text."""
    buf, starts, text = _laid_out(texts)
    size, tables = len(buf) - _PAD, _tables(net)
    match = _match_counts(buf)
    first = np.searchsorted(text, np.arange(len(texts)))
    chunk = np.empty((len(starts), FILTERS + MATCH_FILTERS), np.float32)
    for i in range(0, len(starts), _PIECE):
        own = starts[i : i + _PIECE]
        b, e = int(own[0]), int(starts[i + _PIECE]) if i + _PIECE < len(starts) else size
        conv, ends = _convolved(tables, buf, b, e), starts[first]
        ends = ends[(ends > b) & (ends <= e)]
        conv[(ends[:, None] - np.arange(1, WIDTH) - b).ravel()] = tables[:, 0].sum(0)  # padding only, not the next text
        chunk[i : i + _PIECE, :FILTERS] = np.maximum.reduceat(conv, own - b)
        chunk[i : i + _PIECE, FILTERS:] = np.maximum.reduceat(match[b // 8 : e // 8] @ net.match, (own - b) // 8)
    follows = np.flatnonzero(text[1:] == text[:-1])
    chunk[follows] = np.maximum(chunk[follows], chunk[follows + 1])
    return np.maximum.reduceat(chunk, first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    v = np.maximum(pooled(net, texts) + net.pool_bias, 0)
    return _sigmoid(np.maximum(v @ net.dense + net.dense_bias, 0) @ net.out + net.out_bias[0]).astype(float)


def _gradients(net: Net, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy; through a maximum only the window that attained it gets a gradient."""
    buf, starts, text = _laid_out(texts)
    tables, match, size = _tables(net), _match_counts(buf), len(buf) - _PAD
    first = starts[np.searchsorted(text, np.arange(len(texts)))]
    ends = np.append(first[1:], size)
    peak = np.empty((len(texts), FILTERS), np.int64)
    spot = np.empty((len(texts), MATCH_FILTERS), np.int64)
    top = np.empty((len(texts), FILTERS + MATCH_FILTERS), np.float32)
    for i, (b, e) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
        conv, planes = _convolved(tables, buf, b, e - WIDTH + 1), match[b // 8 : e // 8] @ net.match
        at, block = conv.argmax(0), planes.argmax(0)
        peak[i], spot[i] = b + at, b // 8 + block
        top[i, :FILTERS] = conv[at, np.arange(FILTERS)]
        top[i, FILTERS:] = planes[block, np.arange(MATCH_FILTERS)]
    pre = top + net.pool_bias
    v = np.maximum(pre, 0)
    pre2 = v @ net.dense + net.dense_bias
    h = np.maximum(pre2, 0)
    d = ((_sigmoid(h @ net.out + net.out_bias[0]) - labels) / len(labels)).astype(np.float32)
    d2 = np.outer(d, net.out) * (pre2 > 0)
    d1 = (d2 @ net.dense.T) * (pre > 0)
    embed, kernel = np.zeros_like(net.embed), np.zeros_like(net.kernel)
    dc = d1[:, :FILTERS]
    for j in range(WIDTH):
        seen = buf[peak + j]  # text, filter
        kernel[j] = np.einsum("nf,nfe->ef", dc, net.embed[seen])
        np.add.at(embed, seen, dc[..., None] * net.kernel[j].T)
    planes = np.einsum("nf,nfl->lf", d1[:, FILTERS:], match[spot])
    return [embed, kernel, planes, d1.sum(0), v.T @ d2, d2.sum(0), h.T @ d, d.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, rate: float, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam over shuffled batches of 32; ``rate`` is the share of label 1 that the scores should assume."""
    net, rng = new_net(seed), np.random.default_rng(seed)
    slow = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step, batches = 0, -(-len(texts) // 32)
    for epoch in range(epochs):
        pace = 0.02 * (1 - epoch / epochs)
        for own in np.array_split(rng.permutation(len(texts)), batches):
            step += 1
            grads = _gradients(net, [texts[i] for i in own], labels[own])
            for p, g, (m, s) in zip(net.parameters(), grads, slow, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    share = labels.mean()
    net.out_bias += np.float32(np.log(rate / (1 - rate)) - np.log(share / (1 - share)))
    return net


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
    max_text_bytes: int = MAX_TEXT_BYTES,
) -> Net | float:
    """The net, or the smoothed share of label 1 where the labelled rows have one class or none."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
    known = written(known.select("id", "label"), "labelled")
    n, ones = known.agg(F.count("*"), F.sum("label")).first()
    rate = ((ones or 0) + 1) / (n + 2)
    order = F.xxhash64("id")
    half = max_rows // 2
    few = min(n - (ones or 0), ones or 0, half)
    sample = known.where("label = 1").orderBy(order, "id").limit(max_rows - min(n - (ones or 0), half))
    sample = sample.unionByName(known.where("label = 0").orderBy(order, "id").limit(max_rows - min(ones or 0, half)))
    if not few:
        return rate
    rows = docs.where(F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) <= max_text_bytes)
    rows = rows.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    rows = rows.join(F.broadcast(sample), "id").orderBy("id", F.xxhash64("text")).limit(max_rows).select("text", "label").collect()
    own = np.array([r["label"] for r in rows], np.float32)
    if not 0 < own.sum() < len(own):
        return rate
    return train([bytes(r["text"] or b"") for r in rows], own, rate)


def score_documents(
    docs: DataFrame, model: Net | float, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id and score."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, _ROWS):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            made = scores(model, texts) if isinstance(model, Net) else np.full(len(texts), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["id", "score"])

    return rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, model: Net | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted (1 from a score of one half) of every row."""
    found = score_documents(docs, model, id_col, text_col)
    return found.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, model: Net | float, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, with all their columns."""
    names = docs.columns
    schema = docs.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = names.index(text_col)
        for batch in bounded(batches, where, _ROWS):
            texts = [(t or "").encode() for t in batch.column(where).to_pylist()]
            made = scores(model, texts) if isinstance(model, Net) else np.full(len(texts), model)
            yield batch.filter(pa.array(made >= least))

    return docs.mapInArrow(kept, schema)
