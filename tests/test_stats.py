"""Formulas against independent arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from gazetta.functions import geo, stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_chi_square_with_correction(spark):
    n, t, g, a = 30, 100, 60, 400
    cells = [[n, t - n], [g - n, a - t - (g - n)]]
    total = a
    want = sum(
        max(abs(cells[i][j] - sum(cells[i]) * (cells[0][j] + cells[1][j]) / total) - 0.5, 0) ** 2 / (sum(cells[i]) * (cells[0][j] + cells[1][j]) / total)
        for i in (0, 1)
        for j in (0, 1)
    )
    assert value(spark, stats.chi2_yates(*lit(n, t, g, a))) == pytest.approx(want)
    assert value(spark, stats.chi2_yates(*lit(5, 5, 5, 5))) == 0


def test_error_function(spark):
    for x in (0.0, 0.1, 1.0, 2.0, 4.0):
        assert value(spark, stats.erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=2e-7)
    assert value(spark, stats.p_value(F.lit(3.841459))) == pytest.approx(0.05, abs=1e-6)
    assert [value(spark, stats.stars(F.lit(x))) for x in (1.0, 4.0, 7.0, 11.0)] == ["ns", "*", "**", "***"]
    assert value(spark, stats.p_value_approx(F.lit(0.0))) == 1


def test_log_odds_and_z(spark):
    assert value(spark, stats.log_odds(*lit(0.5, 0.25))) == pytest.approx(math.log(3))
    assert math.isfinite(value(spark, stats.log_odds(*lit(1.0, 0.0))))
    assert value(spark, stats.z_binomial(*lit(30, 100, 0.2))) == pytest.approx(10 / 4)
    assert value(spark, stats.z_binomial(*lit(0, 100, 0.0))) == 0
    assert value(spark, stats.z_sum(*lit(30, 100, 0.25))) == pytest.approx(1)
    assert value(spark, stats.ngram_log_odds(*lit(0, 0, 1, 1))) == 0
    assert value(spark, stats.lift(*lit(0.8, 0.5))) == pytest.approx(1.6) and value(spark, stats.lift(*lit(0.8, 0.0))) is None
    assert value(spark, stats.smoothed(*lit(1, 2))) == 0.5


def test_wilson(spark):
    low, high = stats.wilson(*lit(8, 10))
    assert (value(spark, low), value(spark, high)) == (pytest.approx(0.49016, abs=1e-5), pytest.approx(0.943318, abs=1e-5))
    low, high = stats.wilson(*lit(0, 0))
    assert (value(spark, low), value(spark, high)) == (0, 0)


def test_rank_sum_of_binary_samples(spark):
    a, b = [1] * 7 + [0] * 3, [1] * 4 + [0] * 16
    u, p = stats.mann_whitney_binary(*lit(7, 10, 4, 20))
    assert value(spark, u) == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert 0.005 < value(spark, p) < 0.02
    u, p = stats.mann_whitney_binary(*lit(1, 2, 4, 20))
    assert value(spark, u) is None and value(spark, p) == 1


def test_mutual_information(spark):
    assert value(spark, stats.pmi(*lit(4, 8, 8, 16, 32))) == pytest.approx(math.log(4))
    assert value(spark, stats.log2_pmi(*lit(4, 8, 8, 32))) == pytest.approx(1) and value(spark, stats.log2_pmi(*lit(0, 8, 8, 32))) == 0
    assert value(spark, stats.shannon(F.array(*lit(1.0, 1.0, 2.0, 0.0)))) == pytest.approx(1.5)


def test_distances(spark):
    assert 100 < value(spark, geo.haversine_km(*lit(113.26, 23.13, 114.06, 22.54))) < 130
    assert value(spark, geo.haversine_km(*lit(0.0, 0.0, 180.0, 0.0))) == pytest.approx(math.pi * 6371)
    lon, lat = geo.wgs_to_gcj(*lit(113.0, 23.0))
    assert 0.001 < abs(value(spark, lon) - 113) < 0.01 and 0.001 < abs(value(spark, lat) - 23) < 0.01
    back = geo.bd_to_gcj(*geo.gcj_to_bd(*lit(113.0, 23.0)))
    assert value(spark, back[0]) == pytest.approx(113, abs=1e-5) and value(spark, back[1]) == pytest.approx(23, abs=1e-5)
