"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space.

1. A scan measures every text; lengths that several rows have survive.
2. A scan takes the prefix hash of the rows of such lengths; (length, prefix) pairs that several rows have survive.
3. A scan takes the full hash of the rows of such pairs, and only of these.  Equal (length, prefix, hash) is one group.

Every level is a grouped count with partial aggregation, so a length or a text shared by a third of the rows reaches
the reducers as one row per map task.  What survives a level is a written table.  If it has at most BROADCAST_ROWS rows
it is applied inside the next scan; beyond that the next level is computed for all rows and joined afterwards.  Either
way only ids, lengths and hashes are shuffled between the levels, never texts.

Edge cases
    null or empty text   both count as the empty text and form one group
    very long text       measured and hashed whole
    null id              never the row that stays while the group has another id; a group of null ids keeps them
    repeated rows        rows with equal id and equal text are one document: the annotation keeps them all,
                         ``drop_exact_duplicates`` returns one of them
    one id, many texts   each text is judged on its own
    empty table          empty result of the same columns
    extra columns        carried through by ``drop_exact_duplicates`` whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.scratch import written

PREFIX_CHARS = 64
#: Rows of numbers, about 64 bytes each in memory, that are sent to every executor.
BROADCAST_ROWS = 1 << 19
_KEY = ["n", "prefix"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _measured(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, normalised text t and its length n in bytes."""
    text = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("t"), *more)
    return text.withColumn("n", F.octet_length("t"))


def _within(rows: DataFrame, keys: DataFrame, on: list[str], few: bool) -> DataFrame:
    """``rows`` that meet one of ``keys``, tested next to the scan; all of them where the keys are not few."""
    return rows.join(F.broadcast(keys), on, "left_semi") if few else rows


class _Levels:
    """The written tables of the three levels over one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, prefix_chars: int):
        prefix = F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix")
        sha = F.unhex(F.sha2(F.col("t"), 256)).alias("sha")
        texts, several = _measured(docs, id_col, text_col), F.col("count") > 1
        self.measured = written(texts.select("id", "n"), "measured")
        self.lengths = written(self.measured.groupBy("n").count().where(several).select("n"), "lengths")
        short_list = self.lengths.count() <= BROADCAST_ROWS
        alike = _within(texts, self.lengths, ["n"], short_list).select("id", "n", "t", prefix)
        self.alike = written(alike.select("id", *_KEY).join(self.lengths, "n", "left_semi"), "alike")
        self.pairs = written(self.alike.groupBy(_KEY).count().where(several).select(_KEY), "pairs")
        hashed = _within(alike, self.pairs, _KEY, self.pairs.count() <= BROADCAST_ROWS).select("id", *_KEY, sha)
        self.hashed = written(hashed.join(self.pairs, _KEY, "left_semi"), "hashed")
        by_id = self.hashed.groupBy(*_KEY, "sha", "id").agg(F.count("*").alias("c"))
        groups = by_id.groupBy(*_KEY, "sha").agg(
            F.min("id").alias("keep_id"), F.sum("c").alias("size"), F.min_by("c", "id").alias("keepers")
        )
        self.groups = written(groups.where("size > 1"), "groups")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    digest_all: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and text_sha256.

    ``text_sha256`` is null for rows that the first two levels already showed to be unique, unless ``digest_all`` asks
    for the digest of every row: then one more scan hashes those rows, and those only.
    """
    found = _Levels(docs, id_col, text_col, prefix_chars)
    none = F.lit(None).cast("binary").alias("sha")
    if digest_all:
        prefix = F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix")
        rest = _measured(docs, id_col, text_col).select("id", "n", "t", prefix)
        if found.pairs.count() <= BROADCAST_ROWS:
            rest = rest.join(F.broadcast(found.pairs), _KEY, "left_anti").select("id", F.unhex(F.sha2("t", 256)).alias("sha"))
        else:
            rest = rest.select("id", *_KEY, F.unhex(F.sha2("t", 256)).alias("sha")).join(found.pairs, _KEY, "left_anti")
    else:
        rest = found.measured.join(found.lengths, "n", "left_anti").select("id", none)
        rest = rest.unionByName(found.alike.join(found.pairs, _KEY, "left_anti").select("id", none))
    own = found.hashed.join(found.groups, [*_KEY, "sha"], "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id")
    own = own.select("id", keep, F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), "sha")
    rest = rest.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    return own.unionByName(rest).select("id", "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row goes if its (id, length, prefix) is among those of rows that go and so is its full hash, which is taken for
    no other row.  The list of rows that go is read next to the scan while it has at most BROADCAST_ROWS rows; a longer
    one needs a shuffle of the rows themselves.
    """
    found = _Levels(docs, id_col, text_col, prefix_chars)
    own = found.hashed.join(found.groups, [*_KEY, "sha"])
    first = F.col("id").eqNullSafe(F.col("keep_id"))
    gone = written(own.where(~first).select("id", *_KEY, "sha").distinct(), "gone")
    again = written(own.where(first & (F.col("keepers") > 1)).select("id", *_KEY, "sha").distinct(), "again")
    prefix = F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix")
    rows = _measured(docs, id_col, text_col, F.struct(*(docs[c] for c in docs.columns)).alias("row")).select("*", prefix)

    def among(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        near = F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed
        keys = rows["id"].eqNullSafe(near["id"]) & (rows["n"] == near["n"]) & (rows["prefix"] == near["prefix"])
        # not an equality, so that the join hashes a text only where the other three already meet
        return rows.join(near, keys & ~(F.unhex(F.sha2(rows["t"], 256)) != near["sha"]), how)

    stay = among(rows, gone, "left_anti")
    if again.isEmpty():
        return stay.select("row.*")
    once = among(stay, again, "left_semi").dropDuplicates(["id", "t"])
    return among(stay, again, "left_anti").select("row.*").unionByName(once.select("row.*"))
