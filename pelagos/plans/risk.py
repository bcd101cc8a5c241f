"""Factor risk of a panel with decaying memory, and joint tests of intercepts.

A time's factor returns come from one regression over its instruments, whose normal equations are sums over groups of
bounded size.  Covariances then decay along time: the recursion is run block by block in parallel, block sums carry the
state over, and a second pass adds what was carried.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagos.functions.elementwise import over
from pelagos.operators.factors import time_index
from pelagos.plans.evaluation import f_tail
from pelagos.scratch import written

#: Rows of a time that one group of the regression holds.
GROUP_ROWS = 1 << 18


def decayed(rows: DataFrame, halflife: float, keys: Sequence[str] = (), block: int = 256, out: str = "s") -> DataFrame:
    """``rows`` (keys, t, x: array) with s, the exponentially weighted mean of x so far: it starts with the first x of a
    key and moves by 1 - 2^(-1/halflife) of the way at every row.

    ``t`` numbers the rows of time, gaps do not count.  A block of ``block`` times is walked in one task, blocks in
    parallel; between them goes one row per key and block.
    """
    pace, columns = 1 - 0.5 ** (1 / halflife), rows.columns
    cut = rows.withColumn("block", F.floor(F.col("t") / block))

    def walk(x: np.ndarray, state: np.ndarray | None) -> np.ndarray:
        made = np.empty_like(x)
        for i, v in enumerate(x):
            state = v if state is None else pace * v + (1 - pace) * state
            made[i] = state
        return made

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        """What a block adds to the state it begins with, and how much of that is left."""
        x = np.stack(pdf.sort_values("t")["x"].to_list())
        left = (1 - pace) ** len(x)
        own = walk(x, np.zeros_like(x[0]))[-1]
        first = walk(x, None)[-1]
        return pdf[[*keys, "block"]].iloc[:1].assign(left=left, own=[own], first=[first])

    sums = cut.groupBy(*keys, "block").applyInPandas(ends, f"{kinds}block long, left double, own array<double>, first array<double>")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        state, made = None, []
        for r in pdf.itertuples():
            made.append(state)
            state = np.asarray(r.first) if state is None else r.left * state + np.asarray(r.own)
        return pdf[[*keys, "block"]].assign(state=made)

    states = written(sums, "ends").groupBy(*keys).applyInPandas(carry, f"{kinds}block long, state array<double>")

    def second(own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("t")
        carried = state["state"].iloc[0]
        made = walk(np.stack(own["x"].to_list()), None if carried is None else np.asarray(carried))
        return own[columns].assign(**{out: list(made)})

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return cut.groupBy(*keys, "block").cogroup(states.groupBy(*keys, "block")).applyInPandas(second, schema)


def factor_returns(panel: DataFrame, ret: str, exposures: list[str], ridge: float = 1e-8) -> DataFrame:
    """(t, ts, x): returns of the exposures' factors at each time, from a regression of ``ret`` over its instruments.

    Missing returns and exposures count as zero; an exposure that no instrument has gets zero.
    """
    rows = panel.join(time_index(panel), "ts").select("t", "inst", ret, *exposures)
    most = rows.groupBy("t").count().agg(F.max("count")).first()[0] or 1
    buckets = math.ceil(most / GROUP_ROWS)
    k = len(exposures)

    def equations(key: tuple, table: pa.Table) -> pa.Table:
        b = np.nan_to_num(np.column_stack([table[c].cast(pa.float64()).to_numpy() for c in exposures]))
        r = np.nan_to_num(table[ret].cast(pa.float64()).to_numpy())
        sums = np.concatenate([b.T @ r, (b.T @ b).ravel()])
        return pa.table({"t": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums], pa.list_(pa.float64()))})

    dealt = rows.groupBy("t", F.pmod(F.xxhash64("inst"), F.lit(buckets)).alias("bucket"))
    sums = dealt.applyInArrow(equations, "t int, sums array<double>")

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.sum(np.stack(pdf["sums"].to_list()), axis=0)
        x = np.linalg.solve(s[k:].reshape(k, k) + ridge * np.eye(k), s[:k])
        return pd.DataFrame({"t": [pdf["t"].iloc[0]], "x": [x]})

    made = sums.groupBy("t").applyInPandas(solved, "t int, x array<double>")
    return written(made.join(time_index(panel), "t").select("t", "ts", "x"), "factor-returns")


def factor_risk(factors: DataFrame, halflife: float = 60.0, block: int = 256) -> DataFrame:
    """ts and cov, the K by K covariance of the factors (row after row) with decaying memory, about zero."""
    outer = F.flatten(F.transform("x", lambda a: F.transform(F.col("x"), lambda b: a * b)))
    made = decayed(factors.select("t", "ts", outer.alias("x")), halflife, block=block)
    return made.select("ts", F.col("s").alias("cov"))


def specific_risk(panel: DataFrame, ret: str, exposures: list[str], factors: DataFrame, halflife: float = 60.0, group_rows: int = 1 << 20) -> DataFrame:
    """ts, inst and variance of what the factors leave of the returns, with decaying memory.

    Instruments are dealt over groups of about ``group_rows`` rows, each with whole series.
    """
    rows = panel.join(factors, "ts")
    told = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col("x")[i] for i, c in enumerate(exposures)), F.lit(0.0))
    rest = F.coalesce(F.col(ret).cast("double"), F.lit(0.0)) - told
    rows = rows.select("ts", "inst", (rest * rest).alias("q"))
    buckets = max(1, math.ceil(panel.count() / group_rows))
    pace = 1 - 0.5 ** (1 / halflife)

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["inst", "ts"], kind="stable")
        own = pdf.groupby("inst", sort=False, dropna=False)["q"]
        return pdf[["ts", "inst"]].assign(variance=own.ewm(alpha=pace, adjust=False).mean().to_numpy())

    schema = T.StructType([panel.schema["ts"], panel.schema["inst"], T.StructField("variance", T.DoubleType())])
    return rows.groupBy(F.pmod(F.xxhash64("inst"), F.lit(buckets)).alias("bucket")).applyInPandas(walked, schema)


def joint_intercepts(returns: DataFrame, market: DataFrame) -> DataFrame:
    """One row: k alphas, n times, f and p of the test that no alpha has an intercept beside the market's return.

    ``returns`` has alpha, ts and r, ``market`` ts and m; only times count at which all of them are there.  Intercepts and
    the covariance of what the market leaves come from moments of pairs, summed in Spark; K by K numbers are solved.
    Without k + 5 times, or with dependent alphas, there is no statistic and p is 1; no alphas give no row.
    """
    rows = returns.where(F.col("r").isNotNull()).join(market.where(F.col("m").isNotNull()), "ts")
    rows = rows.groupBy("alpha", "ts").agg(F.avg("r").alias("r"), F.avg("m").alias("m"))
    names = rows.select("alpha").distinct().count()
    if names > 1000:
        raise ValueError("more than 1000 alphas; choose before")
    whole = rows.groupBy("ts").count().where(F.col("count") == names).select("ts")
    rows = written(rows.join(whole, "ts"), "complete")
    one = rows.groupBy("alpha").agg(F.avg("r").alias("mean"), F.covar_samp("r", "m").alias("c"), F.avg("m").alias("mm"), F.var_samp("m").alias("vm"), F.count("*").alias("n"))
    a = rows.select("ts", F.col("alpha").alias("a"), F.col("r").alias("x"))
    b = rows.select("ts", F.col("alpha").alias("b"), F.col("r").alias("y"))
    pairs = a.join(b, "ts").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))
    beta = over(F.col("c"), F.col("vm"))
    sides = one.select(F.col("alpha").alias("a"), beta.alias("beta_a"), "mean", "mm", "vm", "n")
    others = one.select(F.col("alpha").alias("b"), beta.alias("beta_b"))
    table = pairs.join(sides, "a").join(others, "b")
    table = table.select("a", "b", (F.col("cov") - F.col("beta_a") * F.col("beta_b") * F.col("vm")).alias("rest"), (F.col("mean") - F.col("beta_a") * F.col("mm")).alias("intercept"), "mm", "vm", "n")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        cov = pdf.pivot(index="a", columns="b", values="rest").to_numpy()
        alpha = pdf.drop_duplicates("a").sort_values("a")["intercept"].to_numpy()
        k, n, mean, var = len(alpha), int(pdf["n"].iloc[0]), pdf["mm"].iloc[0], pdf["vm"].iloc[0]
        f = None
        if n >= k + 5 and not np.isnan(cov).any() and np.linalg.matrix_rank(cov) == k:
            square = mean * mean / (var * (n - 1) / n) if var > 0 else 0.0
            f = n / k * (n - k - 1) / (n - 2) * float(alpha @ np.linalg.solve(cov, alpha)) / (1 + square)
        return pd.DataFrame([(k, n, f, 1.0 if f is None else f_tail(f, n - k - 1, k))], columns=["k", "n", "f", "p"])

    return table.groupBy().applyInPandas(test, "k int, n long, f double, p double")


def effective_rank(values: np.ndarray) -> float:
    """Exponential of the entropy of the eigenvalues' shares; zero without any."""
    values = np.clip(values, 0, None)
    if values.sum() <= 0:
        return 0.0
    share = values[values > 0] / values.sum()
    return float(np.exp(-(share * np.log(share)).sum()))


def position_products(positions: DataFrame, most_alphas: int = 2000, cells: int = 1 << 22) -> tuple[list, DataFrame]:
    """Sorted names of the alphas, and (ts, gram) with the products of every two alphas' positions, summed over instruments.

    ``positions`` has ts, alpha, inst and w; a missing position is zero.
    """
    rows = positions.where(F.col("w").isNotNull()).select("ts", "alpha", "inst", F.col("w").cast("double").alias("w"))
    names = sorted(r[0] for r in rows.select("alpha").distinct().limit(most_alphas + 1).collect())
    if len(names) > most_alphas:
        raise ValueError(f"more than {most_alphas} alphas; choose before")
    place, k = {n: i for i, n in enumerate(names)}, len(names)
    buckets = max(1, math.ceil(rows.select("inst").distinct().count() * k / cells))

    def products(key: tuple, table: pa.Table) -> pa.Table:
        inst = table["inst"].combine_chunks().dictionary_encode()
        x = np.zeros((len(inst.dictionary), k))
        np.add.at(x, (np.asarray(inst.indices), [place[a] for a in table["alpha"].to_pylist()]), table["w"].to_numpy())
        return pa.table({"ts": pa.array([key[0].as_py()], table.schema.field("ts").type), "gram": pa.array([(x.T @ x).ravel()], pa.list_(pa.float64()))})

    kind = rows.schema["ts"].dataType.simpleString()
    made = rows.groupBy("ts", F.pmod(F.xxhash64("inst"), F.lit(buckets)).alias("bucket")).applyInArrow(products, f"ts {kind}, gram array<double>")
    cell = made.select("ts", F.posexplode("gram").alias("at", "g")).groupBy("ts", "at").agg(F.sum("g").alias("g"))
    whole = cell.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("at", "g"))).alias("c"))
    return names, written(whole.select("ts", F.col("c.g").alias("gram")), "grams")


def position_rank(positions: DataFrame) -> DataFrame:
    """ts and rank: how many independent alphas a time's positions amount to, from the entropy of their eigenvalues."""
    names, grams = position_products(positions)
    k = len(names)

    def ranked(batches):
        for pdf in batches:
            values = [np.linalg.eigvalsh(np.reshape(g, (k, k))) for g in pdf["gram"]]
            yield pd.DataFrame({"ts": pdf["ts"], "rank": [effective_rank(np.where(v > 1e-10 * v.max(), v, 0)) for v in values]})

    return grams.mapInPandas(ranked, f"ts {grams.schema['ts'].dataType.simpleString()}, rank double")


def decoded_returns(positions: DataFrame, expected: DataFrame, ridge: float = 0.0) -> DataFrame:
    """inst and r: returns of instruments at the last time that explain the alphas' expected returns best.

    ``expected`` has ts, alpha and e; a missing one is zero.  Alphas weigh by the inverse variance of what positions left
    unexplained at the times before (equally where that is nothing).  Only products between alphas are inverted, with
    ``ridge`` on their diagonal, or as a pseudo-inverse without: the instruments' returns are one join and grouped sum.
    """
    names, grams = position_products(positions)
    k, place = len(names), {n: i for i, n in enumerate(names)}
    each = expected.where(F.col("e").isNotNull()).groupBy("ts", "alpha").agg(F.sum("e").alias("e"))
    each = each.groupBy("ts").agg(F.collect_list(F.struct("alpha", "e")).alias("es"))
    last = F.lit(grams.agg(F.max("ts")).first()[0])
    rows = grams.join(each, "ts", "left").withColumn("is_last", F.col("ts") == last)

    def inverse(g: np.ndarray) -> np.ndarray:
        return np.linalg.inv(g + ridge * np.eye(k)) if ridge else np.linalg.pinv(g, rcond=1e-12, hermitian=True)

    def rests(batches):
        """Squares and sums of what is left at every time but the last, whose products and returns go on."""
        for pdf in batches:
            made = []
            for r in pdf.itertuples():
                e = np.zeros(k)
                for x in r.es if r.es is not None else []:
                    if x["alpha"] in place:
                        e[place[x["alpha"]]] = x["e"]
                g = np.reshape(r.gram, (k, k))
                made.append((r.is_last, e - g @ (inverse(g) @ e), e, r.gram))
            yield pd.DataFrame(made, columns=["is_last", "rest", "e", "gram"])

    left = written(rows.mapInPandas(rests, "is_last boolean, rest array<double>, e array<double>, gram array<double>"), "rests")
    spread = left.where("NOT is_last").select(F.posexplode("rest").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("v"))
    spread = np.array([r["v"] for r in spread.orderBy("at").collect()])  # one number per alpha

    def solved(batches):
        for pdf in batches:
            made = []
            for r in pdf.itertuples():
                v = spread if len(spread) else np.zeros(k)
                v = np.maximum(v, 1e-9 * v.max()) if v.max() > 1e-24 else np.ones(k)
                root = np.sqrt(v.mean() / v)
                y = root * (inverse(root[:, None] * np.reshape(r.gram, (k, k)) * root) @ (root * np.asarray(r.e)))
                made += list(zip(names, map(float, y), strict=True))
            yield pd.DataFrame(made, columns=["alpha", "y"])

    parts = left.where("is_last").mapInPandas(solved, f"alpha {positions.schema['alpha'].dataType.simpleString()}, y double")
    own = positions.where((F.col("ts") == last) & F.col("w").isNotNull())
    return own.join(parts, "alpha").groupBy("inst").agg(F.sum(F.col("w") * F.col("y")).alias("r"))
