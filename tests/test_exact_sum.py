"""Sums in long integers against exact fractions."""

import math
import random
from fractions import Fraction

from sensevec.operators.summation import compensated_sum, stable_mean

TINY, HUGE = 5e-324, 1.7976931348623157e308


def exact(values):
    total = sum(map(Fraction, values), Fraction(0))
    try:
        return total.numerator / total.denominator  # division of integers is rounded once
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def groups():
    rng = random.Random(3)
    out = {
        "cancel": [1e16, 1.0, -1e16],
        "tiny": [TINY] * 5 + [-TINY],
        "subnormal": [2.2250738585072014e-308, -TINY, TINY * 3],
        "huge": [HUGE, -HUGE / 2, -HUGE / 4],
        "over": [HUGE, HUGE],
        "under": [-HUGE, -HUGE],
        "back": [HUGE, HUGE, -HUGE],
        "half even": [2.0**53, 1.0],
        "half up": [2.0**53, 1.0, TINY],
        "half down": [2.0**53 + 2, -1.0, -TINY],
        "zeros": [0.0, -0.0],
        "powers": [2.0**k for k in range(-1074, 1023, 7)],
        "minus powers": [-(2.0**k) for k in range(-1074, 1023, 5)] + [2.0**k for k in range(-1070, 1020, 3)],
        "near powers": [math.nextafter(2.0**k, s) for k in range(-300, 300, 11) for s in (0.0, math.inf)],
    }
    for k in range(40):
        scale = rng.choice([1, 10, 300, 1000])
        out[f"r{k}"] = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.uniform(-scale, min(scale, 1000)) for _ in range(rng.randrange(1, 60))]
    return out


def test_sums_equal_fractions(spark):
    made = groups()
    rows = [(k, v) for k, values in made.items() for v in values] + [("cancel", None), ("none", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = {r.k: (r.total, r.n) for r in compensated_sum(df, "k", "v").collect()}
    for k, values in made.items():
        assert found[k] == (exact(values), len(values)), k
    assert found["none"] == (0.0, 0)
    means = {r.k: r["mean"] for r in stable_mean(df, "k", "v").collect()}
    assert means["cancel"] == 1.0 / 3 and means["none"] is None


def test_values_that_are_no_numbers(spark):
    inf, nan = math.inf, math.nan
    made = {"a": [inf, 1.0], "b": [-inf, 1.0], "c": [inf, -inf], "d": [nan, 1.0, inf], "e": [inf, HUGE, HUGE]}
    df = spark.createDataFrame([(k, v) for k, values in made.items() for v in values], "k string, v double")
    found = {r.k: r.total for r in compensated_sum(df, "k", "v").collect()}
    assert found["a"] == found["e"] == inf and found["b"] == -inf and math.isnan(found["c"]) and math.isnan(found["d"])


def test_no_python_in_the_plan(spark):
    df = spark.range(10).selectExpr("id % 2 as k", "cast(id as double) as v")
    plan = compensated_sum(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
