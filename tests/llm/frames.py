"""Small tables with the awkward cases every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(df):
    """Extra columns named like those that operators use inside."""
    names = ["id", "t", "n", "row", "fp", "size", "count", "score", "root", "hashes", "bucket", "gone_id", "kept"]
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(n) for n in names))


AWKWARD = [None, "", "   \t\n", "one", "two words", "a b 　 c", "naïve Zürich İstanbul", "x" * 5000, "emoji 😀 " * 50, "tie tie tie"]


def table(rows):
    """Rows as sorted text, doubles to nine digits."""
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in rows)
