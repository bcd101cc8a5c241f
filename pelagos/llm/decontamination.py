"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

A test item is short and a document may be very long, so their Jaccard similarity says nothing; what counts is how much
of the item the document contains.  Items are partitioned by shingle count.  For an item of ``n`` shingles and a
threshold ``t``, a document that contains at least ``t * n`` of them lacks at most ``n - ceil(t * n)``, hence it holds
one of any ``n - ceil(t * n) + 1`` chosen shingles.  The sketch of an item is that many of its smallest MinHash values,
so the size fixes the sketch depth and no containing document is missed, however long it is.  Documents look their
shingle hashes up in the sketches of the partitions that they are large enough to contain; a hit is counted on hashes
and then compared shingle by shingle as text.

Documents never leave their task.  Items travel to the tasks in blocks of at most ``block_shingles`` shingles, one pass
over the documents for each block; an item longer than a block is a block of its own.

Words are maximal runs of letters and digits of the lower-cased text.  An item of fewer words than a shingle is a single
shingle of its own length: it is looked up among all runs of so many words, whatever the length of the document.

Edge cases
    null or empty text   no shingles: an item is never found, a document contains nothing
    very long text       looked up whole
    ids of any type      carried as they are
    null id              reported like any other, and ``remove_contaminated`` drops contaminated rows of null id
    repeated rows, ties  each row, each item row and each pair that reaches the threshold is reported
    empty table          empty result of the same columns
    extra columns        ignored by name, or carried through by ``remove_contaminated``
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.llm.words import bounded, split_words, window_hashes, window_starts, word_hashes
from pelagos.scratch import written

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
BLOCK_SHINGLES = 1 << 20
_ROWS = 2048


def shingle_set(words: list[str], width: int) -> set[str]:
    if not words:
        return set()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _shingles(own: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of a batch's word hashes, the text of each, and where it begins."""
    starts, text = window_starts(bounds, width)
    return (window_hashes(own, width)[starts] if len(starts) else np.empty(0, np.uint64)), text, starts


class ItemIndex:
    """Sketches and shingles of a block of items, by size partition."""

    def __init__(self, items: list[tuple[object, str]], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        self.ids, self.shingles, self.hashes, self.need = [], [], [], []
        words, bounds = split_words(pa.array([t for _, t in items], pa.string()), lower_words=True)
        all_words = word_hashes(words)
        hashes, text, _ = _shingles(all_words, bounds, width)
        short: dict[int, list[tuple[int, int]]] = {}
        order = np.argsort(text, kind="stable")
        ends = np.searchsorted(text[order], np.arange(len(items) + 1))
        sketches: dict[int, list[tuple[int, int]]] = {}
        for i, (item, _) in enumerate(items):
            own = np.unique(hashes[order[ends[i] : ends[i + 1]]])
            shingles = shingle_set(words[bounds[i] : bounds[i + 1]].to_pylist(), width)
            if not shingles:
                continue
            need = math.ceil(round(threshold * len(shingles), 9))
            if (count := int(bounds[i + 1] - bounds[i])) < width:
                own = window_hashes(all_words[bounds[i] : bounds[i + 1]], count)
                short.setdefault(count, []).append((int(own[0]), len(self.ids)))
                shingles, need = {" ".join(words[bounds[i] : bounds[i + 1]].to_pylist())}, 1
            for h in own[: len(own) - need + 1].tolist() if count >= width else ():
                sketches.setdefault(len(own).bit_length(), []).append((h, len(self.ids)))
            self.ids.append(item)
            self.shingles.append(shingles)
            self.hashes.append(own)
            self.need.append(need)
        self.partitions = []
        for _, entries in sorted(sketches.items()):
            entries.sort()
            least = min(self.need[i] for _, i in entries)
            self.partitions.append((least, np.array([h for h, _ in entries], np.uint64), np.array([i for _, i in entries])))
        self.short = {k: (np.array([h for h, _ in sorted(e)], np.uint64), [i for _, i in sorted(e)]) for k, e in short.items()}

    def _short_items(self, words: pa.Array, own: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) of every item of fewer words than a shingle, compared word by word."""
        for k, (sketch, items) in self.short.items():
            hashes, text, starts = _shingles(own, bounds, k)
            begin = np.searchsorted(sketch, hashes, "left")
            found = set()
            for j in np.flatnonzero(sketch[np.minimum(begin, len(sketch) - 1)] == hashes).tolist():
                at = begin[j]
                while at < len(sketch) and sketch[at] == hashes[j]:
                    pair = (int(text[j]), items[at])
                    if pair not in found and " ".join(words[starts[j] : starts[j] + k].to_pylist()) in self.shingles[items[at]]:
                        found.add(pair)
                    at += 1
            yield from found

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of every text of a batch that contains enough of an item."""
        words, bounds = split_words(texts, lower_words=True)
        all_words = word_hashes(words)
        yield from ((i, item, 1) for i, item in sorted(self._short_items(words, all_words, bounds)))
        hashes, text, _ = _shingles(all_words, bounds, self.width)
        sizes = np.bincount(text, minlength=len(texts))
        pairs = set()
        for least, sketch, items in self.partitions:
            begin = np.searchsorted(sketch, hashes, "left")
            hit = np.flatnonzero((sketch[np.minimum(begin, len(sketch) - 1)] == hashes) & (sizes[text] >= least))
            for k in hit.tolist():
                at = begin[k]
                while at < len(sketch) and sketch[at] == hashes[k]:
                    pairs.add((int(text[k]), int(items[at])))
                    at += 1
        order = np.argsort(text, kind="stable") if pairs else None
        of, own, exact = -1, None, None
        for i, item in sorted(pairs):
            if i != of:
                b, e = np.searchsorted(text, [i, i + 1], sorter=order)
                of, own, exact = i, np.unique(hashes[order[b:e]]), None
            if np.isin(self.hashes[item], own, assume_unique=True).sum() >= self.need[item]:
                exact = exact or shingle_set(words[bounds[i] : bounds[i + 1]].to_pylist(), self.width)
                if (shared := len(exact & self.shingles[item])) >= self.need[item]:
                    yield i, item, shared


def _blocks(items: DataFrame, width: int, block_shingles: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        text = row["text"] or ""
        if block and size + len(text) // 2 > block_shingles:
            yield block
            block, size = [], 0
        item = row["item_id"]
        block.append((bytes(item) if isinstance(item, bytearray) else item, text))
        size += len(text) // 2
    yield block


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = SHINGLE_WORDS,
    threshold: float = CONTAINMENT,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document and item it contains: id, item_id, n_shingles of the item, n_shared and containment."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    wanted = items.select(items[item_id_col].alias("item_id"), items[item_text_col].alias("text"))
    id_type, item_type = (f.schema[0].dataType.simpleString() for f in (rows, wanted))
    item_kind = wanted.select("item_id").limit(0).toArrow().schema.field(0).type
    schema = f"id {id_type}, item_id {item_type}, n_shingles long, n_shared long, containment double"

    def found(block: list[tuple[object, str]]) -> DataFrame:
        index = ItemIndex(block, width, threshold)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, 1, _ROWS):
                hits = list(index.search(batch.column(1)))
                at = pa.array([i for i, _, _ in hits], pa.int64())
                n = [len(index.shingles[j]) for _, j, _ in hits]
                columns = [
                    batch.column(0).take(at),
                    pa.array([index.ids[j] for _, j, _ in hits], item_kind),
                    pa.array(n, pa.int64()),
                    pa.array([s for _, _, s in hits], pa.int64()),
                    pa.array([s / k for (_, _, s), k in zip(hits, n, strict=True)], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "item_id", "n_shingles", "n_shared", "containment"])

        return rows.mapInArrow(search, schema)

    blocks = _blocks(wanted, width, block_shingles)
    parts = [found(next(blocks))]
    for block in blocks:
        parts[-1] = written(parts[-1], "contained")
        parts.append(found(block))
    return reduce(DataFrame.unionByName, parts)


def remove_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows that share the id of a contaminated one go with it."""
    found = contained_items(docs, items, id_col, text_col, **options)
    gone = written(found.select(F.col("id").alias("gone_id")).distinct(), "contaminated")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]), "left_anti")
