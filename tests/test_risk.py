"""Decaying covariances, joint tests, ranks and decoded returns against plain linear algebra."""

import datetime as dt

import numpy as np
import pytest

from pelagos.plans import risk
from pelagos.plans.evaluation import f_tail

DAY0 = dt.datetime(2024, 1, 1)


def day(t):
    return DAY0 + dt.timedelta(int(t))


def recursion(x, halflife):
    pace, state, made = 1 - 0.5 ** (1 / halflife), None, []
    for v in x:
        state = v if state is None else pace * v + (1 - pace) * state
        made.append(state)
    return np.array(made)


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_decay_across_blocks(spark, block):
    rng = np.random.default_rng(0)
    rows = [(k, t, rng.normal(size=3).tolist()) for k in ("a", None) for t in range(3, 30) if (k, t) not in {("a", 3), ("a", 11), ("a", 12)}]
    frame = spark.createDataFrame(rows, "k string, t int, x array<double>").repartition(3)
    got = {(r.k, r.t): r.s for r in risk.decayed(frame, 5.0, ("k",), block).collect()}
    for k in ("a", None):
        own = [r for r in rows if r[0] == k]
        np.testing.assert_allclose([got[k, r[1]] for r in own], recursion(np.array([r[2] for r in own]), 5.0))
    one = [r for r in rows if r[0] is None]
    alone = {r.t: r.s for r in risk.decayed(spark.createDataFrame(one, "k string, t int, x array<double>"), 2.0, (), block).collect()}
    np.testing.assert_allclose([alone[r[1]] for r in one], recursion(np.array([r[2] for r in one]), 2.0))
    assert risk.decayed(frame.limit(0), 5.0, ("k",), block).count() == 0


@pytest.mark.parametrize("group", [1 << 18, 7])
def test_factor_and_specific_risk(spark, group, monkeypatch):
    monkeypatch.setattr(risk, "GROUP_ROWS", group)
    rng = np.random.default_rng(1)
    t, n = 15, 20
    b, r = rng.normal(size=(t, n, 2)), rng.normal(size=(t, n)) * 0.02
    rows = [(day(i), j, float(b[i, j, 0]), float(b[i, j, 1]), float(r[i, j])) for i in range(t) for j in range(n)]
    rows[5] = (*rows[5][:4], None)
    r[0, 5] = 0
    panel = spark.createDataFrame(rows, "ts timestamp, inst int, p double, q double, r double").repartition(3)
    factors = risk.factor_returns(panel, "r", ["p", "q"])
    f = np.array([np.linalg.solve(b[i].T @ b[i] + 1e-8 * np.eye(2), b[i].T @ r[i]) for i in range(t)])
    cov = np.array([x.cov for x in risk.factor_risk(factors, 4.0, 6).orderBy("ts").collect()]).reshape(t, 2, 2)
    np.testing.assert_allclose(cov, recursion(np.einsum("ti,tj->tij", f, f), 4.0))
    rest = (r - np.einsum("tnk,tk->tn", b, f)) ** 2
    got = np.zeros((t, n))
    for x in risk.specific_risk(panel, "r", ["p", "q"], factors, 4.0, 6).collect():
        got[(x.ts - DAY0).days, x.inst] = x.variance
    np.testing.assert_allclose(got, recursion(rest, 4.0))
    assert risk.factor_risk(risk.factor_returns(panel.limit(0), "r", ["p", "q"])).count() == 0


def test_tail_of_f_is_the_tabulated_one():
    for f, d1, d2, p in [(3.0984, 3, 20, 0.05), (4.1028, 2, 10, 0.05), (3.6990, 5, 30, 0.01), (161.4476, 1, 1, 0.05), (2.3479, 10, 20, 0.05)]:
        assert abs(f_tail(f, d2, d1) - p) < 2e-5
    assert f_tail(0.0, 5, 3) == 1.0


@pytest.mark.parametrize("k", [1, 2, 5])
def test_joint_intercepts(spark, k):
    rng = np.random.default_rng(k)
    n = 40
    m = rng.normal(size=n) * 0.02 + 0.001
    r = 0.5 * m[:, None] + rng.normal(size=(n, k)) * 0.01 + 0.002
    rows = [(f"a{i}", day(t), None if (i, t) == (0, 3) else float(r[t, i])) for t in range(n) for i in range(k)]
    market = [(day(t), None if t == 7 else float(m[t])) for t in range(n + 2) if t < n]
    got = risk.joint_intercepts(spark.createDataFrame(rows, "alpha string, ts timestamp, r double"), spark.createDataFrame(market, "ts timestamp, m double")).first()
    ok = np.array([t not in (3, 7) for t in range(n)])
    r, m = r[ok], m[ok]
    n = len(m)
    x = np.column_stack([np.ones(n), m])
    beta = np.linalg.lstsq(x, r, rcond=None)[0]
    cov = np.atleast_2d(np.cov((r - x @ beta).T))
    f = n / k * (n - k - 1) / (n - 2) * beta[0] @ np.linalg.inv(cov) @ beta[0] / (1 + m.mean() ** 2 / m.var())
    assert (got.k, got.n) == (k, n)
    np.testing.assert_allclose([got.f, got.p], [f, f_tail(f, n - k - 1, k)], rtol=1e-8)


def test_joint_intercepts_without_enough(spark):
    rows = [(a, day(t), float(t % 3 * (2 if a == "b" else 1))) for t in range(20) for a in "ab"]
    market = spark.createDataFrame([(day(t), float(t % 5)) for t in range(20)], "ts timestamp, m double")
    frame = spark.createDataFrame(rows, "alpha string, ts timestamp, r double")
    dependent = risk.joint_intercepts(frame, market).first()
    assert dependent.f is None and dependent.p == 1.0
    short = risk.joint_intercepts(frame.where("ts < '2024-01-04'"), market).first()
    assert short.n == 3 and short.f is None and short.p == 1.0
    assert risk.joint_intercepts(frame.limit(0), market).count() == 0


def positions(spark, w):
    """(ts, alpha, inst, w) of w[t, alpha, inst]."""
    rows = [(day(t), f"a{a:02d}", i, float(w[t, a, i])) for t in range(w.shape[0]) for a in range(w.shape[1]) for i in range(w.shape[2]) if w[t, a, i] != 0]
    return spark.createDataFrame([*rows, (day(0), "a00", 0, None)], "ts timestamp, alpha string, inst int, w double").repartition(3)


def test_planted_returns_and_ranks_come_back(spark):
    rng = np.random.default_rng(3)
    w = rng.normal(size=(6, 12, 8)) * (rng.random((6, 12, 8)) < 0.8)
    r = rng.normal(size=(6, 8)) * 0.02
    e = np.einsum("tai,ti->ta", w, r)
    noisy = e.copy()
    noisy[:5, 3] += rng.normal(size=5)  # one alpha that positions do not explain
    for told in (e, noisy):
        rows = [(day(t), f"a{a:02d}", float(told[t, a])) for t in range(6) for a in range(12)] + [(day(5), "unknown", 1.0)]
        found = risk.decoded_returns(positions(spark, w), spark.createDataFrame(rows, "ts timestamp, alpha string, e double"))
        got = {x.inst: x.r for x in found.collect()}
        np.testing.assert_allclose([got[i] for i in range(8)], r[5], atol=1e-9)
    base = np.linalg.qr(rng.normal(size=(9, 3)))[0]
    flat = np.einsum("ak,ki->ai", base, np.linalg.qr(rng.normal(size=(8, 3)))[0].T)[None]  # three equal directions
    rank = risk.position_rank(positions(spark, flat)).first()["rank"]
    np.testing.assert_allclose(rank, 3.0, rtol=1e-9)
    assert risk.effective_rank(np.zeros(3)) == 0.0 and risk.effective_rank(np.array([2.0, 2.0, 0.0])) == pytest.approx(2.0)


def test_decoding_nothing(spark):
    none = positions(spark, np.zeros((1, 2, 2))).limit(0)
    expected = spark.createDataFrame([], "ts timestamp, alpha string, e double")
    assert risk.decoded_returns(none, expected).count() == 0
    assert risk.position_rank(none).count() == 0
