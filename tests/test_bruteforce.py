"""Queries that run Python (LCS, stems, t tail), checked against a plain-Python brute force on
the small fixture (whole tables at sf0.001), beside their SQL oracles."""

import re

import pytest

from evalspark.functions.porter import stem
from evalspark.plans.catalog import QUERIES
from evalspark.operators.stats import t_two_sided_p


def _tokens(text, stemmed):
    toks = [t for t in re.split(r"[^a-z0-9]+", (text or "").lower()) if t]
    return [stem(t) if stemmed and len(t) > 3 else t for t in toks]


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


def _rouge_l(ref, pred, stemmed):
    r, p = _tokens(ref, stemmed), _tokens(pred, stemmed)
    if not r or not p:
        return 0.0
    lcs = _lcs(r, p)
    prec, rec = lcs / len(p), lcs / len(r)
    return 0.0 if prec + rec == 0 else 2 * prec * rec / (prec + rec)


@pytest.mark.parametrize("name,stemmed", [("m3b_rouge_l", False), ("m3b_rouge_l_stemmed", True)])
def test_rouge_l_query_matches_brute_force(spark, sf, name, stemmed):
    from evalspark import fixtures as fx

    pairs = {(r.conv_id, r.turn): (r.reference, r.prediction) for r in fx.pairs(spark, sf).collect()}
    got = {(r.conv_id, r.turn): r.f for r in QUERIES[name](spark, sf).collect()}
    assert got.keys() == pairs.keys() and len(got) > 0
    for k, (ref, pred) in pairs.items():
        assert got[k] == pytest.approx(_rouge_l(ref, pred, stemmed), abs=1e-12)


def _p_by_integration(t, df, n=400_000):
    """Two-sided tail of Student's t by integrating its density (x = |t| + tan(theta))."""
    import math

    import numpy as np

    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    th = np.linspace(0.0, math.pi / 2, n, endpoint=False)
    x = abs(t) + np.tan(th)
    f = c * (1 + x * x / df) ** (-(df + 1) / 2) / np.cos(th) ** 2
    return 2 * float(np.sum((f[1:] + f[:-1]) / 2 * np.diff(th)))


def test_p_values_query(spark, sf):
    rows = QUERIES["t2_t3_p_values"](spark, sf).collect()
    assert rows
    for r in rows:
        assert r.p_value == pytest.approx(_p_by_integration(r.t_statistic, r.n_pairs - 1.0), abs=3e-5)
        assert r.significant_at_0_05 == (r.p_value < 0.05)
    assert t_two_sided_p(2.0, 5.0) == pytest.approx(_p_by_integration(2.0, 5.0), abs=2e-5)
