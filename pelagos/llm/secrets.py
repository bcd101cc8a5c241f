"""Secret scans with structural confirmation.

Three base patterns report assignments, access keys and long hex runs as they stand.  Beyond them, candidates that only
look like key material are decoded and parsed before they are reported.

der     base64 (plain or URL-safe, on one line or wrapped over lines) or hex; every offset of a run where the header of a
        sequence may begin is tried.  A private key is a sequence whose lengths fit at every level of nesting: a version
        number and further elements, or, encrypted, an algorithm sequence with an object identifier and an octet string
ssh     base64 of the OpenSSH magic and its length-prefixed fields
pem     an armoured block of either, with or without header lines, its line breaks real or written as backslash n
jwt     a signed token whose header is a JSON object that names an algorithm

Edge cases
    null or empty text   no spans
    very long text       scanned whole
    null id              carried through
    repeated rows, ties  every row is scanned on its own; spans sort by start, then by kind as listed in KINDS
    empty table          empty result of the same columns
    extra columns        ignored by name
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pelagos.llm.words import bounded

KINDS = ("assign", "access", "hex", "der", "jwt", "pem", "ssh")
_ROWS = 1024

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Base64 runs, wrapped ones included: lines of 40 and more that follow each other directly.
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{4,})*={0,2}")
#: Where a sequence may begin: its tag and a length, in base64 (at any of four places of a byte triple) and in hex.
_SEQUENCE = re.compile(r"M[A-P][A-Za-z0-9+/_-]")
_HEX_SEQUENCE = re.compile(r"(?=30(?:8[1-4]|[1-7][0-9A-Fa-f])[0-9A-Fa-f]{28})")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_ARMOUR = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:\s|\\[rn])+(?:[A-Za-z-]+: [^\n\\]*(?:\s|\\[rn])+)*)"
    r"((?:[A-Za-z0-9+/=\s]|\\[rn])+)-----END \1-----"
)
_SSH_MAGIC = b"openssh-key-v1\0"
_VERSION, _OCTETS, _IDENTIFIER, _SEQUENCE_TAG, _CONSTRUCTED = 0x02, 0x04, 0x06, 0x30, 0x20

#: What a text must hold for each group of patterns to match; searched for over whole batches first.
_HINTS = {
    "assign": r"(?i)password|passwd|secret|token|api_?key",
    "plain": r"AKIA|[0-9a-f]{24}|eyJ|-----BEGIN|[A-Za-z0-9+/_-]{40}",
}


def _base64(text: str) -> bytes:
    body = re.sub(r"\s", "", text).rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if re.search("[-_]", body) else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def _der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill ``data`` exactly; None where a length does not fit."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size = int.from_bytes(data[at : at + more], "big")
            at += more
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def _nests(items: list[tuple[int, bytes]] | None, depth: int = 0) -> bool:
    """Whether the lengths of all elements fit at every level below, to a depth that no key reaches."""
    if items is None or depth > 16:
        return False
    return all(_nests(_der_items(content), depth + 1) for tag, content in items if tag & _CONSTRUCTED)


def _outer_size(data: bytes) -> int | None:
    """Bytes of the element at the start of ``data``, by its header; None without room for one."""
    if len(data) < 2:
        return None
    more = data[1] & 0x7F if data[1] & 0x80 else 0
    if more > 4 or len(data) < 2 + more or (data[1] & 0x80 and not more):
        return None
    return 2 + more + (int.from_bytes(data[2 : 2 + more], "big") if more else data[1])


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is a private key: one sequence, with lengths that fit at every level."""
    outer = _der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = _der_items(outer[0][1])
    if not inner or not _nests(inner):
        return False
    tags = [tag for tag, _ in inner]
    if tags == [_SEQUENCE_TAG, _OCTETS]:  # encrypted: algorithm, then the ciphertext in whole blocks
        algorithm = _der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == _IDENTIFIER and len(inner[1][1]) >= 16 and len(inner[1][1]) % 8 == 0
    return len(inner) >= 3 and tags[0] == _VERSION and len(inner[0][1]) == 1 and inner[0][1][0] <= 3


def _der_at(data: bytes) -> int:
    """Bytes of the private key that ``data`` begins with; 0 for none."""
    size = _outer_size(data)
    return size if size is not None and 32 <= size <= len(data) and is_der_key(data[:size]) else 0


def _hex_keys(run: str, start: int) -> list[tuple[int, int, str]]:
    """DER keys in a run of hex digits, at any offset."""
    found, done = [], 0
    for m in _HEX_SEQUENCE.finditer(run):
        if m.start() < done:
            continue
        at = m.start()
        header = bytes.fromhex(run[at : at + 12])
        size = _outer_size(header)
        if size is not None and 32 <= size <= (len(run) - at) // 2 and is_der_key(bytes.fromhex(run[at : at + 2 * size])):
            done = at + 2 * size
            found.append((start + at, start + done, "der"))
    return found


def _encoded_keys(run: str, start: int) -> list[tuple[int, int, str]]:
    """DER and OpenSSH keys in a base64 run, whole or from any place where the header of a sequence may begin."""
    flat, places = [], []
    for i, c in enumerate(run):
        if not c.isspace():
            flat.append(c)
            places.append(start + i)
    text, found = "".join(flat).rstrip("="), []
    if is_ssh_key(_base64(text)):
        return [(start, start + len(run), "ssh")]
    done = 0
    for m in _SEQUENCE.finditer(text):
        if m.start() < done:
            continue
        size = _outer_size(_base64(text[m.start() : m.start() + 8]))
        chars = -(-4 * size // 3) if size else 0
        if size and 32 <= size and m.start() + chars <= len(text) and _der_at(_base64(text[m.start() : m.start() + chars])) == size:
            end = m.start() + chars
            last = start + len(run) if end == len(text) else places[end - 1] + 1
            found.append((places[m.start()], last, "der"))
            done = end
    return found


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` begins with the OpenSSH magic and three length-prefixed names that fit."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)
    for _ in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if at > len(data):
            return False
    return True


def is_signed_token(token: str) -> bool:
    """Whether the first part of ``token`` decodes to a JSON object that names an algorithm."""
    try:
        header = json.loads(_base64(token.split(".")[0]))
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _legacy(headers: str, data: bytes) -> bool:
    """Whether a block's header lines say that its bytes are encrypted, and they are whole blocks."""
    return "ENCRYPTED" in headers and "DEK-Info:" in headers and len(data) >= 64 and len(data) % 8 == 0


def _spans(kind: str, pattern: re.Pattern, text: str, holds: Callable[[re.Match], bool]) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), kind) for m in pattern.finditer(text) if holds(m)]


def find_secrets(text: str | None, assign: bool = True, plain: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret, by start and kind; the flags skip patterns known not to match."""
    found, text = [], text or ""
    if assign:
        found += _spans("assign", _ASSIGN, text, lambda m: len(m[2]) >= 6)
    if plain:
        found += _spans("access", _ACCESS, text, lambda m: len(m[0]) >= 20)
        found += _spans("hex", _HEX, text, lambda m: True)
        for m in _HEX_RUN.finditer(text):
            found += _hex_keys(m[0], m.start())
        for m in _ENCODED.finditer(text):
            found += _encoded_keys(m[0], m.start())
        found += _spans("jwt", _TOKEN, text, lambda m: is_signed_token(m[0]))
        found += _spans("pem", _ARMOUR, text, lambda m: is_der_key(d := _base64(re.sub(r"\\[rn]", "", m[3]))) or is_ssh_key(d) or _legacy(m[2], d))
    return sorted(set(found), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and secrets, an array of (kind, start, end) in code points, end exclusive."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1, _ROWS):
            texts = pc.fill_null(batch.column(1), "")
            assign, plain = (pc.match_substring_regex(texts, _HINTS[k]).to_pylist() for k in ("assign", "plain"))
            spans = [find_secrets(t.as_py(), a, p) if a or p else [] for t, a, p in zip(texts, assign, plain, strict=True)]
            made = [[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], names=["id", "secrets"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, secrets array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(scan, schema)
