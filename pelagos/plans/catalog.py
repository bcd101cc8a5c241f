"""Catalog of expressions, runs and evaluations as tables, and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_alphas(alphas: DataFrame, evaluations: DataFrame, least_sharpe: float, n: int) -> DataFrame:
    """The ``n`` best evaluated alphas that are not archived."""
    live = alphas.where(~F.coalesce("archived", F.lit(False)))
    both = live.join(evaluations.where(F.col("sharpe") >= least_sharpe), live["id"] == evaluations["alpha_id"])
    return both.select(live["id"], "expression", "sharpe").orderBy(F.col("sharpe").desc(), live["id"]).limit(n)


def latest_evaluations(evaluations: DataFrame) -> DataFrame:
    """Each alpha's last evaluation; of equal times the greatest id."""
    last = Window.partitionBy("alpha_id").orderBy(F.col("evaluated_at").desc(), F.col("id").desc())
    return evaluations.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")


def summary(alphas: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Per category: alphas, archived ones, evaluated ones, evaluations and best Sharpe."""
    seen = evaluations.groupBy("alpha_id").agg(F.count("*").alias("k"), F.max("sharpe").alias("best"))
    both = alphas.join(seen, alphas["id"] == seen["alpha_id"], "left")
    return both.groupBy("category").agg(
        F.count("*").alias("alphas"), F.sum(F.coalesce("archived", F.lit(False)).cast("int")).alias("archived"),
        F.count("alpha_id").alias("evaluated"), F.coalesce(F.sum("k"), F.lit(0)).alias("evaluations"), F.max("best").alias("best"),
    )


def pnl_correlation(stored: DataFrame, pnl: list[float], least: int = 20) -> DataFrame:
    """Correlation of a candidate's PnL with stored arrays over their common tail; short or flat ones are left out."""
    mine = F.array(*(F.lit(float(x)) for x in pnl))
    n = F.least(F.size("pnl"), F.size(mine))
    pairs = F.zip_with(F.slice(F.col("pnl"), -n, n), F.slice(mine, -n, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    made = stored.where(F.least(F.size("pnl"), F.lit(len(pnl))) >= least).select("id", n.alias("n"), pairs.alias("p"))
    mean = lambda f: F.aggregate("p", F.lit(0.0), lambda s, e: s + e[f]) / F.col("n")
    made = made.select("id", "n", "p", mean("x").alias("mx"), mean("y").alias("my"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda s, e: s + f(e["x"] - F.col("mx"), e["y"] - F.col("my")))
    made = made.select("id", total(lambda x, y: x * y).alias("c"), total(lambda x, y: x * x).alias("a"), total(lambda x, y: y * y).alias("b"))
    return made.where("a > 0 AND b > 0").select("id", (F.col("c") / F.sqrt(F.col("a") * F.col("b"))).alias("corr"))


def selection_history(selections: DataFrame, alphas: DataFrame, run_id: int) -> DataFrame:
    """A run's selections with expression and category of each alpha; by bar, and within it the greatest weight first.

    ``place`` says the order; ties go by alpha.
    """
    own = selections.where(F.col("run_id") == run_id)
    both = own.join(alphas.select(F.col("id").alias("alpha_id"), "expression", "category"), "alpha_id")
    order = Window.partitionBy("bar_index").orderBy(F.desc_nulls_last("weight"), "alpha_id")
    return both.withColumn("place", F.row_number().over(order))


def as_pairs(correlations: DataFrame) -> DataFrame:
    """Correlations under ordered pairs of alphas; of several for a pair the last one computed."""
    pair = correlations.withColumn("a", F.least("alpha_a", "alpha_b")).withColumn("b", F.greatest("alpha_a", "alpha_b"))
    last = F.max_by("correlation", F.struct("computed_at", "correlation")).alias("correlation")
    return pair.where("a <> b").groupBy("a", "b").agg(last, F.max("computed_at").alias("computed_at"))
