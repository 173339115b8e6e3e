"""Sums that lie on a threshold or on a rounding tie: the same values in any order give the same result, the exact one."""

import random

import pytest

from tessera.operators import features as X


def orders(spark, values, column):
    """The values as one column of chosen cells (negative ones: rejected) under 30 features, each in an order of its own."""
    rows, rng = [], random.Random(0)
    for f in range(30):
        own = values[:]
        rng.shuffle(own)
        rows += [(i, "C" if v > 0 else "R", f, 1.0 if column == "freq" else abs(v), abs(v) if column == "freq" else 1.0) for i, v in enumerate(own)]
    return spark.createDataFrame(rows, "row_idx long, side string, feature int, max_act double, freq double")


def test_a_mean_on_the_threshold_is_kept_in_any_order(spark):
    values = [-(i % 10 + 1) / 100 for i in range(130)] + [(i % 10 + 1) / 100 for i in range(110)] + [-0.1] * 4
    assert sum(round(100 * v) for v in values) == -150  # over 15,000 rows: exactly -1e-4
    got = X.retained(orders(spark, values, "freq"), 15_000).collect()
    assert {(r["mean_d"], r["keep_response"]) for r in got} == {(-1e-4, True)} and len({r["sigma_d"] for r in got}) == 1


def test_mean_and_total_activation_in_any_order(spark):
    values = [(i % 50 + 1) / 50 for i in range(250)] + [0.1, 0.2, 0.3, 0.7, 0.82, 3.42]
    assert sum(round(100 * v) for v in values) == 13_304  # a mean of 0.5196875, a tie at six decimals
    got = X.firing_stats(orders(spark, values, "max_act")).collect()
    assert {(r["n_examples"], r["mean_act"], r["total"]) for r in got} == {(256, 0.5196875, 133.04)}


@pytest.mark.parametrize("value", [float("inf"), 1e300, 3e-12])
def test_sums_of_extreme_values(spark, value):
    got = X.firing_stats(spark.createDataFrame([(i, "C", 1, value, 1.0) for i in range(4)], "row_idx long, side string, feature int, max_act double, freq double")).collect()
    assert [(r["mean_act"], r["total"]) for r in got] == [(pytest.approx(value), pytest.approx(4 * value))]
