"""Fill-in-middle: a text is cut at two unit borders into prefix, middle and suffix and written in training order.

While the units of a text are counted, a sparse index keeps the byte and code-point offsets of every ``every``-th unit.
A cut is found by binary search in that index and a short scan from the checkpoint before it, so a text is read once
whatever its length, and the index holds one entry for ``every`` units.

Forms of the output, with the sentinels ``<P>``, ``<S>`` and ``<M>``
    plain   the text
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

Edge cases
    null or empty text   no units, plain, empty output
    sentinel in a text   plain, so that every other output can be taken apart again
    very long text       scanned block by block; only the text, its output and the index are held
    fewer units          cuts may fall together: prefix, middle or suffix is empty, an empty text is plain
    null id              hashed as the empty string; carried through
    repeated rows, ties  every row is cut on its own; equal ids and texts give equal outputs
    empty table          empty result of the same columns
    extra columns        ignored by name; only the id and the text are read
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm.words import bounded

EVERY = 64
BLOCK = 1 << 20


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for a in astuple(self):
            if any(a[i:] == b[: len(a) - i] for b in astuple(self) for i in range(len(a)) if i or a is not b):
                raise ValueError("no sentinel may end as another or itself begins")


def _code_points(raw: bytes, start: int, end: int) -> np.ndarray:
    """Whether each byte of ``raw[start:end]`` begins a code point."""
    return (np.frombuffer(raw, np.uint8, end - start, start) & 0xC0) != 0x80


class Checkpoints:
    """Number of units of a text, and byte and code-point offsets of every ``every``-th one."""

    def __init__(self, raw: bytes, unit: str = "line", every: int = EVERY, block: int = BLOCK):
        if unit not in ("line", "char"):
            raise ValueError(f"unknown unit: {unit}")
        self.raw, self.unit = raw, unit
        lines = unit == "line"
        first = [0] if lines else []  # where the text begins is a border of code points by itself
        self.units, self.bytes, self.chars = first[:], first[:], first[:]
        seen = chars = 0  # borders and code points that have been passed
        for start in range(0, len(raw), block):
            end = min(start + block, len(raw))
            begins = _code_points(raw, start, end)
            borders = np.flatnonzero(np.frombuffer(raw, np.uint8, end - start, start) == 10) + 1 if lines else np.flatnonzero(begins)
            unit_there = seen + lines  # the unit that follows the first of these borders
            skip = -unit_there % every
            listed = borders[skip::every]
            if len(listed):
                self.units += range(unit_there + skip, unit_there + len(borders), every)
                self.bytes += (listed + start).tolist()
                self.chars += (np.concatenate([[0], np.cumsum(begins)])[listed] + chars).tolist()
            seen += len(borders)
            chars += int(np.count_nonzero(begins))
        self.total_chars = chars
        self.n = seen + (lines and bool(raw) and not raw.endswith(b"\n"))

    def locate(self, cut: int) -> tuple[int, int]:
        """Byte and code-point offset of the border before unit ``cut`` (``n``: the end)."""
        if cut >= self.n:
            return len(self.raw), self.total_chars
        i = bisect_right(self.units, cut) - 1
        at, chars, left = self.bytes[i], self.chars[i], cut - self.units[i]
        begin = at
        if self.unit == "char":
            begins = np.flatnonzero(_code_points(self.raw, at, min(at + 4 * (left + 1), len(self.raw))))
            return at + int(begins[left]), chars + left
        for _ in range(left):
            at = self.raw.index(b"\n", at) + 1
        return at, chars + int(np.count_nonzero(_code_points(self.raw, begin, at)))


def _draws(doc_id, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def arranged(raw: bytes, draws: list[int], unit: str, every: int, fim_percent: int, spm_percent: int, signs: tuple[bytes, bytes, bytes]) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    index = Checkpoints(raw, unit, every)
    if not raw or any(s in raw for s in signs) or draws[2] % 100 >= fim_percent:
        return index.n, "plain", None, None, raw
    low, high = sorted(d % (index.n + 1) for d in draws[:2])
    (a, a_chars), (b, b_chars) = index.locate(low), index.locate(high)
    p, s, m = signs
    spm = draws[3] % 100 < spm_percent
    parts = [s, raw[b:], p, raw[:a], m, raw[a:b]] if spm else [p, raw[:a], s, raw[b:], m, raw[a:b]]
    return index.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, b"".join(parts)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    sentinels: Sentinels = Sentinels(),
    every: int = EVERY,
) -> DataFrame:
    """Per row: id, n (units), form, prefix_chars and middle_chars (code points, null if plain) and output.

    unit: ``line`` (with its line feed) or ``char``.  ``fim_percent`` of the documents are cut at all, ``spm_percent`` of
    those begin with the suffix; both, and the cuts, follow from the seed and the id.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    signs = tuple(s.encode() for s in astuple(sentinels))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, 4096):
            ids = batch.column(0).to_pylist()
            found = [
                arranged(raw.as_py() or b"", _draws(i, seed), unit, every, fim_percent, spm_percent, signs)
                for i, raw in zip(ids, batch.column(1), strict=True)
            ]
            n, form, prefix, middle, output = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return rows.mapInArrow(made, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that ``output`` of the given form was made from."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in astuple(sentinels)))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
