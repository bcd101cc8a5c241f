"""SimHash near-dedup by multi-index hashing.

Fingerprints are cut into segments.  If two differ in at most ``distance`` bits, then some segment differs in few:
with ``m`` segments and ``distance = m * r + s``, one of the first ``s + 1`` segments in at most ``r`` bits or one of
the others in at most ``r - 1``.  So every fingerprint enumerates these small Hamming balls, fetches the table's
fingerprints that have exactly such a segment value, and the join keeps a match only after comparing all 64 bits.
Every link within the distance is found, whatever the segments; their number only trades probes for comparisons and
follows from the measured number of fingerprints.

Equal fingerprints are one node from the start.  Before the full search, each fingerprint is compared with the most
frequent fingerprint of each of its segment values, which joins most of a large group of near copies at linear cost;
the full search then reports only links between groups that are not joined yet, so a dense group never becomes a list
of all its pairs.

Edge cases
    null or empty text   no words: fingerprint zero, linked like any other
    fewer words than 4   the whole word sequence is the one shingle
    very long text       hashed block by block
    repeated rows, ties  equal fingerprints are linked; the smallest id names the component
    null id              joins its component but never names it while another id does
    empty table          empty result of the same columns
    one id, many texts   each row is a document of its own; ``drop_near_duplicates`` tells them apart by a text hash
    extra columns        ignored by name, or carried through by ``drop_near_duplicates``
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm.components import components
from pelagos.scratch import written

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
#: Ids with text hashes, about 64 bytes each in memory, that are sent to every executor.
BROADCAST_ROWS = 1 << 19
_BLOCK = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a UTF-8 text, as an unsigned integer."""
    words = text.lower().split()  # on bytes: A-Z, and the white space [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), _BLOCK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK], strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
        votes += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """id, key (a hash of the text) and fp, the fingerprint as a signed 64-bit integer, of every row."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"), F.xxhash64(docs[text_col]).alias("key"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py() or b"", width) for t in batch.column(1)], np.uint64)
            columns = [batch.column(0), batch.column(2), pa.array(made.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "fp"])

    return rows.mapInArrow(hashed, f"id {rows.schema['id'].dataType.simpleString()}, key long, fp long")


def segment_plan(count: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment, at the least estimated cost for ``count`` fingerprints.

    A probe is a shuffled row; a comparison in the join costs about a twentieth of one.
    """
    plans = []
    for m in (2, 3, 4):
        radius, spare = divmod(distance, m)
        radii = [radius] * (spare + 1) + [radius - 1] * (m - spare - 1)
        bits = [64 // m + (i < 64 % m) for i in range(m)]
        parts = [(sum(bits[i + 1 :]), b, r) for i, (b, r) in enumerate(zip(bits, radii, strict=True)) if r >= 0]
        balls = [sum(1 for k in range(r + 1) for _ in combinations(range(b), k)) for _, b, r in parts]
        seen = sum(ball * count / 2**b for ball, (_, b, _) in zip(balls, parts, strict=True))
        plans.append((count * (sum(balls) + 0.05 * seen), parts))
    return min(plans)[1]


def _segment(fp: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in flips) for k in range(radius + 1) for flips in combinations(range(bits), k)]


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _probes(table: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """Every fingerprint once for each value in the balls around its segments."""
    def around(part: int, shift: int, bits: int, radius: int) -> Column:
        own = _segment(F.col("fp"), shift, bits)
        flips = _numbers(_ball(bits, radius))
        return F.transform(flips, lambda flip: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(flip).alias("value")))

    each = [around(i, *segment) for i, segment in enumerate(plan)]
    return table.select("*", F.explode(F.concat(*each)).alias("at")).select("*", "at.part", "at.value").drop("at")


def _entries(table: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """Every fingerprint once under each of its segment values."""
    each = [F.struct(F.lit(i).alias("part"), _segment(F.col("fp"), s, b).alias("value")) for i, (s, b, _) in enumerate(plan)]
    return table.select("*", F.explode(F.array(*each)).alias("at")).select("*", "at.part", "at.value").drop("at")


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def near_components(table: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp and root for the fingerprints that reach a smaller one; ``table`` has unique fp and copies, their rows."""
    plan = segment_plan(table.count(), distance)
    entries = written(_entries(table, plan), "entries")
    hubs = entries.groupBy("part", "value").agg(F.max_by("fp", F.struct("copies", "fp")).alias("hub"), F.count("*").alias("c"))
    hubs = written(hubs.where("c > 1").drop("c"), "hubs")
    star = entries.join(hubs, ["part", "value"]).where((F.col("fp") != F.col("hub")) & _near(F.col("fp"), F.col("hub"), distance))
    star = written(star.select("fp", "hub").distinct(), "star")
    first = components(star, "fp", "hub")
    joined = table.select("fp").join(first.select(F.col("node").alias("fp"), "root"), "fp", "left")
    joined = written(joined.select("fp", F.coalesce("root", "fp").alias("root")), "joined")
    a = _probes(joined, plan).select("part", "value", F.col("fp").alias("a"), F.col("root").alias("ra"))
    b = _entries(joined, plan).select("part", "value", F.col("fp").alias("b"), F.col("root").alias("rb"))
    meet = (a["part"] == b["part"]) & (a["value"] == b["value"]) & (a["ra"] < b["rb"]) & _near(a["a"], b["b"], distance)
    links = written(a.join(b, meet).select("ra", "rb").distinct(), "links")
    second = components(links, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("top"))
    found = joined.join(second, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))
    return written(found.where("fp <> root"), "found")


def _members(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> DataFrame:
    """id, key, fp, root (of its component) and component_id of every row."""
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    table = written(rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("id").alias("least")), "table")
    roots = near_components(table.select("fp", "copies"), distance)
    named = table.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = written(named.join(least, "root").select("fp", "root", "component_id"), "of")
    return rows.join(of, "fp").select("id", "key", "fp", "root", "component_id")


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    found = _members(docs, id_col, text_col, width, distance)
    return found.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
) -> DataFrame:
    """One row of each component, with all its columns: the one of smallest id, of several texts under it one of them.

    A row goes by its id and its text together, so rows that share an id are told apart.  The rows that go are listed
    next to the scan while they are at most BROADCAST_ROWS; a longer list needs a shuffle of the rows themselves.
    """
    found = written(_members(docs, id_col, text_col, width, distance), "members")
    first = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("key").alias("stays"))
    named = found.join(written(first, "first"), "root")
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("stays"))
    gone = written(named.where(~stays).select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "gone")
    again = named.where(stays).groupBy(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).count().where("count > 1")
    again = written(again.drop("count"), "again")
    key = F.xxhash64(docs[text_col])

    def among(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        near = F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed
        return rows.join(near, rows[id_col].eqNullSafe(near["gone_id"]) & (key == near["gone_key"]), how)

    stay = among(docs, gone, "left_anti")
    if again.isEmpty():
        return stay
    once = among(stay, again, "left_semi").dropDuplicates([id_col, text_col])
    return among(stay, again, "left_anti").unionByName(once)
