"""Audit of how filters interact: what every order of five filters removes, step by step.

The words of all texts are exploded, counted by (document, word) and then by document, which gives totals and distinct
words.  A full outer join adds the other flags, and one aggregation by part takes 32 conditional counts, one for every
combination of the five flags (and as many for good and for toxic documents).  The report of all 120 orders is computed
from those columns alone.

Scale
    Texts are dealt by document once, before words are exploded, so both word counts need no further shuffle and no pair
    of document and word ever crosses the network.  Documents are rows of equal id and text; equal rows are dealt over
    several tasks and weighed once.  Identical texts are found by grouped minimum of ids by digest; the join back is a
    sort-merge join that Spark may split where one text has a third of the rows.

Edge cases
    null or empty text   an empty text without words: fails A, not B
    null lang            part ''
    null id              never a copy and never the smaller id of another row; its labels are unknown
    repeated rows        each counts; equal ids are not smaller, so they are no copies of each other
    ties                 several label rows of a document: good or toxic if one of them says so
    very long text       one row of words at a time; its distinct words are held by the aggregation
    empty table          empty report
    extra columns        ignored by name
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.scratch import written

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
#: Tasks that rows of one id and one text are dealt over.
SPREAD = 16
_DOC = ["id", "hash"]


def _hash(text: Column) -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(text)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (of the text), n_words and n_distinct of every different pair of id and text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    own = docs.select(docs[id_col].alias("id"), text.alias("text"), _hash(text).alias("hash"))
    own = own.withColumn("deal", F.spark_partition_id() % SPREAD).repartition(*_DOC, "deal")
    # the null beside the words counts the rows of this id and text, whose words are then counted once
    each = F.concat(F.split("text", SPACE), F.array(F.lit(None).cast("string")))
    words = own.select(*_DOC, "deal", F.explode(each).alias("word")).where("word IS NULL OR word <> ''")
    by_word = words.groupBy(*_DOC, "deal", "word").agg(F.count("*").alias("c"))
    total = F.sum(F.when(F.col("word").isNotNull(), F.col("c")))
    rows = F.max(F.when(F.col("word").isNull(), F.col("c")))
    dealt = by_word.groupBy(*_DOC, "deal").agg(
        F.coalesce(total, F.lit(0)).alias("total"), rows.alias("rows"), F.count("word").alias("n_distinct")
    )
    dealt = dealt.select(*_DOC, F.expr("total div rows").alias("n_words"), "n_distinct")
    return dealt.groupBy(*_DOC).agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per different row: id, part, rows (how often it occurs), mask (bit 0 to 4: fails A to E), good and toxic.

    A: under 200 words; B: 100 distinct < 50 words; C: 100 `[A-Z]` > 3 code points; D: holds any of ``#$%&*|``; E: the
    text is identical to that of a smaller id.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    part = F.coalesce(docs[part_col], F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    own = docs.select(
        docs[id_col].alias("id"),
        _hash(text).alias("hash"),
        part.alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        (100 * capitals > 3 * F.length(text)).alias("C"),
        text.rlike("[#$%&*|]").alias("D"),
    )
    own = written(own.groupBy(*own.columns).agg(F.count("*").alias("rows")), "flags")
    least = own.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    own = own.join(written(least, "least"), "sha", "left").drop("sha")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    words = written(word_counts(docs, id_col, text_col), "words")
    met = words["id"].eqNullSafe(own["id"]) & (words["hash"] == own["hash"])
    found = words.join(own, met, "full_outer").drop(words["id"], words["hash"]).join(marks, "id", "left")
    fails = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), F.col("C"), F.col("D"), F.col("id") > F.col("least")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    known = (F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    return found.select("id", "part", "rows", mask.alias("mask"), *known)


def _plan() -> Column:
    """(filter_order, step, own bit, bits before) of all 120 orders, as an array."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        steps += [f"{order}:{k + 1}:{bit}:{sum(bits[:k])}" for k, bit in enumerate(bits)]
    fields = lambda s: F.split(s, ":")
    return F.transform(
        F.split(F.lit(",".join(steps)), ","),
        lambda s: F.struct(
            fields(s)[0].alias("filter_order"), *(fields(s)[i].cast("int").alias(n) for i, n in enumerate(("step", "own", "before"), 1))
        ),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    flags = document_flags(docs, labels, id_col, text_col, part_col)
    masks = range(1 << len(FILTERS))
    kinds = {"n": F.lit(True), "g": F.col("good"), "t": F.col("toxic")}
    counts = [F.sum(F.when((F.col("mask") == m) & f, F.col("rows")).otherwise(0)).alias(f"{k}{m}") for k, f in kinds.items() for m in masks]
    by_part = written(flags.groupBy("part").agg(*counts), "masks")
    packed = by_part.select("part", *(F.array(*(f"{k}{m}" for m in masks)).alias(k) for k in kinds))
    steps = packed.select("*", F.explode(_plan()).alias("s")).select("part", *kinds, "s.*")
    own, before = F.col("own"), F.col("before")

    def total(counts: str, where) -> Column:
        chosen = F.transform(counts, lambda n, m: F.when(where(m), n).otherwise(F.lit(0)))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, n: a + n)

    passed = lambda m: m.bitwiseAND(before) == 0
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: passed(m) & fails(m)
    found = steps.select(
        "part",
        "filter_order",
        "step",
        "own",
        total("n", lambda m: passed(m) & ~fails(m)).alias("kept"),
        total("n", gone).alias("removed"),
        total("n", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        F.element_at("n", own + 1).alias("unique_fails"),
        total("g", gone).alias("good_lost"),
        total("t", gone).alias("toxic_lost"),
    )
    shapley = found.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return found.join(shapley, ["part", "own"]).drop("own")
