"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

1. Each task hashes all windows of its documents with two independent rolling hashes.  Within a batch only the earliest
   window of each hash goes on to be counted; the others start earlier in the same batch and are marked at once.
2. Spark deals the windows by hash over buckets whose number follows the text volume, so a bucket has a bounded size; a
   hash reaches its bucket once per batch at most, however many documents hold it.  A grouped count over each bucket
   marks the windows whose hash an earlier document holds too.  Windows travel packed, a row per batch and bucket with
   the positions as compressed gaps: plain rows of them took 5.8 times the text on disk.
3. Marks meet by document and merge into maximal removal intervals, which cut the text.  A document's bucket comes from
   its id and its text together, so the copies of one text spread over all buckets.

Windows count as equal when both hashes are: 64 and 32 bits.  Over the 1.7 * 10**13 windows of 100 TB of text that
leaves an expected 0.002 pairs of different windows that agree; words are not compared beyond that.

Edge cases
    null or empty text   no words: nothing removed, kept text empty
    fewer words than a window   nothing removed
    very long text       hashed whole; its windows spread over all buckets
    id of any type that sorts   compared as Spark sorts it
    null id              sorts after all ids
    one id, many texts   told apart by a 32-bit hash of the text, which also orders them
    repeated rows        rows with equal id and equal text are one document, each returned with the same result
    empty table          empty result of the same columns
    extra columns        ignored by name
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.llm.words import bounded, split_words, window_hashes, window_starts, word_hashes
from pelagos.scratch import written

WINDOW_WORDS = 20
#: Text per bucket of windows.
BUCKET_BYTES = 16 << 20
#: Documents and removal intervals that are sent to every executor, about 100 and 50 bytes each.
BROADCAST_ROWS, BROADCAST_SPANS = 1 << 18, 1 << 19
_ROWS = 2048
_CODEC = "zstd"
_SPANS = "array<struct<begin: long, end: long>>"


def _ranked(ids: pa.Array) -> np.ndarray:
    """Dense ranks of ids, null last."""
    return np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)


def batch_windows(ids: pa.Array, keys: np.ndarray, texts: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """Windows of a batch: hash, second hash, its row, its position, and whether one of the batch starts earlier.

    Rows of equal id and key are one document; only the first of them is read.  Windows stand in the order that decides
    what is earlier.
    """
    rank = _ranked(ids)
    order = np.lexsort((keys, rank))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(rank[order]) != 0) | (np.diff(keys[order]) != 0)
    own = order[new]
    words, bounds = split_words(texts.take(pa.array(own)))
    starts, text = window_starts(bounds, width)
    again = np.zeros(len(starts), bool)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.uint32), own[text], starts, again
    one, two = (window_hashes(word_hashes(words, seed), width)[starts] for seed in (1, 2))
    two = two.astype(np.uint32)
    by_hash = np.lexsort((two, one))
    again[by_hash[1:]] = (np.diff(one[by_hash]) == 0) & (np.diff(two[by_hash]) == 0)
    return one, two, own[text], (starts - bounds[:-1][text]).astype(np.int64), again


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return values >> np.uint64(32)


def _runs(order: np.ndarray, *keys: np.ndarray) -> list[np.ndarray]:
    """``order`` cut where one of the keys changes along it."""
    change = np.zeros(max(len(order) - 1, 0), bool)
    for key in keys:
        change |= np.diff(key[order]) != 0
    return np.split(order, np.flatnonzero(change) + 1) if len(order) else []


class _Packed:
    """Rows of windows: the bucket, the ids of their documents, and the rest compressed."""

    def __init__(self, id_type: pa.DataType, sql_type: str):
        self.id_type = id_type
        self.sql = f"bucket int, n int, size int, ids array<{sql_type}>, side binary, hashes binary"
        kinds = [(c, pa.int32()) for c in ("bucket", "n", "size")]
        self.schema = pa.schema([*kinds, ("ids", pa.list_(id_type)), ("side", pa.binary()), ("hashes", pa.binary())])

    def rows(self, parts: list[tuple[int, np.ndarray, bytes]], ids: pa.Array, keys, homes, doc, at) -> pa.RecordBatch:
        """One row per (bucket, windows, hashes); ``ids``, ``keys`` and ``homes`` by document, ``doc`` and ``at`` by window.

        Of each document its text key and home bucket travel too; positions go as gaps, their bytes laid out in planes.
        """
        out, size = {c: [] for c in ("bucket", "n", "size", "side", "hashes")}, []
        docs = []
        for bucket, where, sums in parts:
            begin = np.flatnonzero(np.diff(doc[where], prepend=-1))
            own, runs = doc[where[begin]], np.diff(np.append(begin, len(where)))
            gaps = np.diff(at[where], prepend=0).astype("<i4")
            raw = b"".join([
                keys[own].astype("<i4").tobytes(), homes[own].astype("<i4").tobytes(), runs.astype("<i4").tobytes(),
                gaps.view("u1").reshape(-1, 4).T.tobytes(),
            ])
            for name, value in zip(out, (bucket, len(where), len(raw), pa.compress(raw, codec=_CODEC, asbytes=True), sums), strict=True):
                out[name].append(value)
            docs.append(own)
            size.append(len(own))
        flat = ids.take(pa.array(np.concatenate(docs) if docs else np.empty(0, np.int64)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
        columns = [pa.array(out[c], self.schema.field(c).type) for c in ("bucket", "n", "size")]
        columns += [lists.cast(pa.list_(self.id_type)), pa.array(out["side"], pa.binary()), pa.array(out["hashes"], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)

    def open(self, table: pa.Table) -> tuple[pa.Array, list[np.ndarray]]:
        """Ids by document, and document, key, home, position and (where they travel) both hashes by window.

        Documents are numbered by row and place in it, so one document has several numbers.
        """
        parts, first = [], 0
        ids = pa.concat_arrays([c.flatten() for c in table.column("ids").chunks]) if table.num_rows else pa.array([], self.id_type)
        sizes = pc.list_value_length(table.column("ids")).to_pylist()
        for row, docs in zip(table.select(["n", "size", "side", "hashes"]).to_pylist(), sizes, strict=True):
            n, raw = row["n"], pa.decompress(row["side"], row["size"], codec=_CODEC)
            keys, homes, runs = (np.frombuffer(raw, "<i4", docs, 4 * docs * i) for i in range(3))
            planes = np.frombuffer(raw, "u1", 4 * n, 12 * docs).reshape(4, n)
            at = np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int64)
            parts.append([np.repeat(first + np.arange(docs), runs), np.repeat(keys, runs), np.repeat(homes, runs), at])
            if row["hashes"]:
                parts[-1] += [np.frombuffer(row["hashes"], "<u8", n), np.frombuffer(row["hashes"], "<u4", n, 8 * n)]
            first += docs
        return ids, [np.concatenate(c) for c in zip(*parts, strict=True)]


def _first_windows(packed: _Packed, width: int, buckets: int):
    """Task body of step 1: rows of first windows by bucket, and, with negative buckets, of windows marked already."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2, _ROWS):
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            homes = (batch.column(3).to_numpy(zero_copy_only=False) % buckets).astype(np.int32)
            one, two, row, at, again = batch_windows(batch.column(0), keys, batch.column(2), width)
            # documents are numbered in the order of their windows
            number = np.cumsum(np.diff(row, prepend=row[:1]) != 0)
            own = row[np.flatnonzero(np.diff(number, prepend=-1))]
            share = (_mixed(one) % np.uint64(buckets)).astype(np.int32)
            share[again] = -1 - homes[row[again]]
            parts = []
            for where in _runs(np.argsort(share, kind="stable"), share):
                bucket = int(share[where[0]])
                parts.append((bucket, where, one[where].tobytes() + two[where].tobytes() if bucket >= 0 else b""))
            yield packed.rows(parts, batch.column(0).take(pa.array(own)), keys[own], homes[own], number, at)

    return hashed


def _marks(packed: _Packed):
    """Task body of step 2, for one bucket: windows that start earlier elsewhere, packed by their documents' bucket."""

    def marked(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:  # packed by document already
            return table.set_column(0, "bucket", pa.array([-1 - bucket] * table.num_rows, pa.int32()))
        ids, (doc, key, home, at, one, two) = packed.open(table)
        order = np.lexsort((two, one))
        same = (np.diff(one[order]) == 0) & (np.diff(two[order]) == 0)
        where = order[np.append(same, False) | np.append(False, same)]  # windows of a hash that occurs several times
        rank = _ranked(ids)[doc[where]]
        sort = np.lexsort((at[where], key[where], rank, two[where], one[where]))
        where, rank = where[sort], rank[sort]
        new = np.ones(len(where), bool)
        new[1:] = (np.diff(one[where]) != 0) | (np.diff(two[where]) != 0)
        head = np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))
        later = (rank != rank[head]) | (key[where] != key[where[head]]) | (at[where] != at[where[head]])
        where, rank = where[later], rank[later]
        sort = np.lexsort((at[where], key[where], rank, home[where]))
        where, rank = where[sort], rank[sort]
        if not len(where):
            return packed.schema.empty_table()
        first = np.ones(len(where), bool)
        first[1:] = (np.diff(rank) != 0) | (np.diff(key[where]) != 0)
        number, own = np.cumsum(first) - 1, where[first]
        fresh = np.ones(len(where), bool)  # repeated rows mark a window once
        fresh[1:] = first[1:] | (np.diff(at[where]) != 0)
        where, number = where[fresh], number[fresh]
        parts = [(int(home[where[p[0]]]), p, b"") for p in _runs(np.arange(len(where)), home[where])]
        return pa.Table.from_batches([packed.rows(parts, ids.take(pa.array(doc[own])), key[own], home[own], number, at[where])])

    return marked


def removal_intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal word intervals [begin, end) that windows at ``starts`` cover; neighbours that touch are merged."""
    at = np.unique(starts).astype(np.int64)
    begin = np.flatnonzero(np.diff(at, prepend=-width - 1) > width)
    return list(zip(at[begin].tolist(), (at[np.append(begin[1:], len(at)) - 1] + width).tolist(), strict=True))


def _intervals(packed: _Packed, width: int):
    """Task body of step 3, for one bucket of documents: the intervals that each document's marks merge into."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def merged(table: pa.Table) -> pa.Table:
        ids, (doc, key, _, at) = packed.open(table)
        rank = _ranked(ids)[doc]
        pieces = _runs(np.lexsort((at, key, rank)), rank, key)
        spans = [removal_intervals(at[p], width) for p in pieces]
        first = np.array([p[0] for p in pieces], np.int64)
        made = pa.array([[{"begin": b, "end": e} for b, e in x] for x in spans], kind)
        return pa.table({"of": ids.take(pa.array(doc[first])).cast(packed.id_type), "key": pa.array(key[first], pa.int32()), "removed": made})

    return merged


def _cut(text: str | None, intervals: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = (text or "").encode().split()
    gone = sum(e - b for b, e in intervals)
    kept, at = [], 0
    for b, e in intervals:
        kept += words[at:b]
        at = e
    return len(words), gone, b" ".join(kept + words[at:]).decode()


def repeated_intervals(docs: DataFrame, id_col: str, text_col: str, width: int, bucket_bytes: int) -> DataFrame:
    """of (an id), key (of its text) and removed, the intervals of every document that loses words; a written table."""
    spark, text = docs.sparkSession, docs[text_col]
    volume = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // bucket_bytes))
    rows = docs.select(docs[id_col].alias("id"), F.hash(text).alias("key"), text.alias("text"))
    rows = rows.withColumn("home", F.shiftrightunsigned(F.xxhash64("id", "key"), 1))
    id_type = rows.schema["id"].dataType.simpleString()
    packed = _Packed(docs.select(docs[id_col]).limit(0).toArrow().schema.field(0).type, id_type)
    windows = rows.mapInArrow(_first_windows(packed, width, buckets), packed.sql).repartition(buckets, "bucket")
    marks = written(windows.groupBy("bucket").applyInArrow(_marks(packed), packed.sql), "marks").repartition(buckets, "bucket")
    found = marks.groupBy("bucket").applyInArrow(_intervals(packed, width), f"of {id_type}, key int, removed {_SPANS}")
    return written(found, "intervals")


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WINDOW_WORDS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, removed (array of word intervals) and kept_text.

    A word goes if a window of ``width`` words covers it whose word sequence also starts earlier: in a document of
    smaller id, or before it in the same document.  Intervals are read next to the scan of the texts while they are
    few; more of them need a shuffle of the texts.
    """
    found = repeated_intervals(docs, id_col, text_col, width, bucket_bytes)
    n, spans = found.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    found = F.broadcast(found) if n <= BROADCAST_ROWS and spans <= BROADCAST_SPANS else found
    rows = docs.select(docs[id_col].alias("id"), F.hash(docs[text_col]).alias("text_key"), docs[text_col].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    both = rows.join(found, rows["id"].eqNullSafe(found["of"]) & (rows["text_key"] == found["key"]), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, _ROWS):
            spans = batch.column(2)
            intervals = [[(x["begin"], x["end"]) for x in own] for own in spans.to_pylist()]
            made = [_cut(t.as_py(), x) for t, x in zip(batch.column(1), intervals, strict=True)]
            n, gone, kept = (pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))
            columns = [batch.column(0), n, gone, spans, kept]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "removed", "kept_text"])

    schema = f"id {id_type}, n_words long, n_removed long, removed {_SPANS}, kept_text string"
    return both.select("id", "text", F.coalesce("removed", F.array().cast(_SPANS)).alias("removed")).mapInArrow(cut, schema)
