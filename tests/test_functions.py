"""Accessor functions, genotype expressions and statistical tests against known values."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe.errors import HelixError
from helixframe.functions import genotype as G
from helixframe.functions import tests as T
from helixframe.functions import variant as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "expected"), [("AGG", "CCT"), ("acgtn", "nACGT"), ("", "")])
def test_revcomp(spark, text, expected):
    assert one(spark, V.revcomp(F.lit(text))) == expected


@pytest.mark.parametrize(("gt", "dose", "missing", "het", "multi"), [("0/0", 0, False, False, False), ("1|0", 1, False, True, False), ("1/1", 2, False, False, False), ("1/2", None, False, True, True), ("./.", None, True, False, False), ("?/?", None, True, False, False), ("1", None, False, False, False)])
def test_genotypes(spark, gt, dose, missing, het, multi):
    row = spark.range(1).select(G.dosage(F.lit(gt)), G.is_missing(F.lit(gt)), G.is_het(F.lit(gt)), G.multi_allelic(F.lit(gt))).first()
    assert tuple(row) == (dose, missing, het, multi)


def test_transitions(spark):
    row = spark.range(1).select(G.is_transition(F.lit("A"), F.lit("G")), G.is_transversion(F.lit("A"), F.lit("G")), G.is_transversion(F.lit("A"), F.lit("C"))).first()
    assert tuple(row) == (True, False, True)


@pytest.mark.parametrize(("t", "chi", "p", "odds", "exact"), [((1, 3, 5, 3), 1.5, 0.2207, 0.2, 0.5455), ((1, 4, 5, 2), 3.086, 0.07898, 0.1, 0.2424)])
def test_two_by_two(spark, t, chi, p, odds, exact):
    c = [F.lit(x) for x in t]
    row = spark.range(1).select(T.chi_square(*c), T.chi_square_p(T.chi_square(*c)), T.odds_ratio(*c), T.fisher(*c), T.fisher(*c, "LESS"), T.fisher(*c, "GREATER")).first()
    assert row[0] == pytest.approx(chi, abs=1e-3) and row[1] == pytest.approx(p, abs=1e-4) and row[2] == pytest.approx(odds) and row[3] == pytest.approx(exact, abs=1e-4)
    at = math.comb(t[0] + t[1], t[0]) * math.comb(t[2] + t[3], t[2]) / math.comb(sum(t), t[0] + t[2])
    assert row[4] + row[5] == pytest.approx(1 + at)


def test_degenerate_tables(spark):
    zero = [F.lit(0)] * 4
    row = spark.range(1).select(T.chi_square(*zero), T.fisher(*zero), T.odds_ratio(F.lit(1), F.lit(0), F.lit(0), F.lit(1))).first()
    assert math.isnan(row[0]) and row[1] == 1.0 and row[2] == math.inf


@pytest.mark.parametrize("x", [0.0, 0.3, 1.0, 2.4, 2.6, 5.0])
def test_erfc(spark, x):
    assert one(spark, T.erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize(("counts", "p"), [((9, 8, 0), 0.520125), ((57, 78, 50), 0.039005), ((0, 0, 0), 1.0)])
def test_hardy_weinberg(spark, counts, p):
    assert one(spark, T.hardy_weinberg(*map(F.lit, counts))) == pytest.approx(p, abs=1e-5)


@pytest.mark.parametrize("method", T.METHODS)
def test_adjusted_p_values(spark, method):
    p = [0.01, 0.02, 0.02, 0.04, 0.5, 1.0, 0.001, 0.3, None]
    got = {r["i"]: r["adjusted"] for r in T.adjust(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", method).collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    m, expected = len(known), {8: None}
    raw = {i: {"bonferroni": v * m, "bh": v * m / k, "by": v * m / k * sum(1 / j for j in range(1, m + 1)), "hochberg": v * (m - k + 1), "holm": v * (m - k + 1)}[method] for k, (v, i) in enumerate(known, 1)}
    best = None
    for _, i in known if method in ("holm", "bonferroni") else known[::-1]:
        best = raw[i] if best is None or method == "bonferroni" else (max if method == "holm" else min)(best, raw[i])
        expected[i] = min(1.0, best)
    assert got.keys() == expected.keys()
    assert all(got[i] is None if e is None else got[i] == pytest.approx(e) for i, e in expected.items())


def test_errors():
    assert "Unknown study" in str(HelixError.unknown_study("a", ["b"])) and isinstance(HelixError("x"), ValueError)
