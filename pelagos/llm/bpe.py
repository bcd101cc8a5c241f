"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding at places where a match of the splitting pattern always ends: a space or line feed
after a letter or digit, and a digit after a letter.  No alternative of the pattern spans such a place and none looks
behind it, so the ids of the parts, joined, are the ids of the whole text.  Decoding joins the raw bytes of the ids.

Edge cases
    null or empty text   no ids, no bytes
    very long text       encoded part by part; a run without a safe boundary stays whole
    repeated rows, ties  every row is encoded on its own
    null id              carried through
    empty table          empty result of the same columns
    extra columns        ignored by name; only the id and the text are read
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 50_000
_SAFE = regex.compile(r"[\p{L}\p{N}](?=[ \n])|[A-Za-z](?=[0-9])")


@functools.lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, built once in each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """``text`` in parts of about ``part_chars``, each ending at a safe boundary."""
    parts, start = [], 0
    while len(text) - start > part_chars:
        cut = _SAFE.search(text, start + part_chars - 1)
        if cut is None:
            break
        parts.append(text[start : cut.end()])
        start = cut.end()
    return [*parts, text[start:]]


def encode(enc, text: str | None, part_chars: int = PART_CHARS) -> np.ndarray:
    """Ids of ``text`` as little-endian unsigned 32-bit integers."""
    ids = [np.array(enc.encode_ordinary(part), "<u4") for part in safe_parts(text or "", part_chars)]
    return np.concatenate(ids)


def encode_documents(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "n_tokens", "ids_sha256", "decoded_sha256"),
) -> DataFrame:
    """Per row: the id and the asked outputs.

    outputs: ids (array of int), n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (bytes decoded from the ids), the digests in lower-case hex.
    """
    kinds = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [encode(enc, text) for text in part.column(1).to_pylist()]
                made = {
                    "ids": lambda: pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32())),  # noqa: B023
                    "n_tokens": lambda: pa.array(map(len, ids), pa.int64()),  # noqa: B023
                    "ids_sha256": lambda: _digests(x.tobytes() for x in ids),  # noqa: B023
                    "decoded_sha256": lambda: _digests(enc.decode_bytes(x.tolist()) for x in ids),  # noqa: B023
                }
                columns = [part.column(0), *(made[name]() for name in outputs)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *outputs])

    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *(f"{n} {kinds[n]}" for n in outputs)])
    return rows.mapInArrow(encoded, schema)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and ``content``, the raw bytes of its ids (null ids: null)."""
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            made = [None if x is None else enc.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "content"])

    return rows.mapInArrow(decoded, f"id {rows.schema['id'].dataType.simpleString()}, content binary")


def _digests(values) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())


def with_token_columns(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    made = encode_documents(docs, rank_file, pattern, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return made.withColumnRenamed("id", "doc_id").select("doc_id", *(F.col(c) for c in made.columns[1:]))
