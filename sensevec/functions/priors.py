"""Stick-breaking sense priors as folds over the array of sense counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import array_total, mean_beta, meanlog_beta, meanlog_mirror

SENSE_THRESHOLD = 1e-3


def _sticks(counts: Column, alpha: float, d: float) -> Column:
    """One ``(a, b)`` Beta parameter pair per sense but the last."""
    head = F.slice(counts, 1, F.greatest(F.size(counts) - 1, F.lit(0)))

    def remaining(k: Column) -> Column:
        # counts above position k (zero-based), never below zero
        tail = F.slice(counts, k + 2, F.size(counts))
        return F.greatest(array_total(tail), F.lit(0.0))

    return F.transform(
        head,
        lambda n, k: F.struct(
            (F.lit(1.0 - d) + n.cast("double")).alias("a"),
            (F.lit(alpha) + (k + 1) * F.lit(d) + remaining(k)).alias("b"),
        ),
    )


def expected_pi(counts: Column, alpha: float, d: float = 0.0) -> Column:
    """Prior probability of every sense; the last one gets what is left of the stick."""
    start = F.struct(F.lit(1.0).alias("rest"), F.array().cast("array<double>").alias("pi"))

    def step(acc: Column, stick: Column) -> Column:
        p = mean_beta(stick["a"], stick["b"]) * acc["rest"]
        return F.struct(
            F.greatest(acc["rest"] - p, F.lit(0.0)).alias("rest"),
            F.concat(acc["pi"], F.array(p)).alias("pi"),
        )

    return F.aggregate(_sticks(counts, alpha, d), start, step, lambda acc: F.concat(acc["pi"], F.array(acc["rest"])))


def expected_logpi(counts: Column, alpha: float, d: float = 0.0) -> Column:
    """Expected log prior of every sense; the last one gets the sum of the mirrored terms."""
    start = F.struct(F.lit(0.0).alias("rest"), F.array().cast("array<double>").alias("logpi"))

    def step(acc: Column, stick: Column) -> Column:
        a, b = stick["a"], stick["b"]
        return F.struct(
            (acc["rest"] + meanlog_mirror(a, b)).alias("rest"),
            F.concat(acc["logpi"], F.array(acc["rest"] + meanlog_beta(a, b))).alias("logpi"),
        )

    return F.aggregate(
        _sticks(counts, alpha, d), start, step, lambda acc: F.concat(acc["logpi"], F.array(acc["rest"]))
    )


def sense_count(pi: Column, min_prob: float = SENSE_THRESHOLD) -> Column:
    """Number of senses that are not negligible."""
    return F.size(F.filter(pi, lambda p: p >= F.lit(min_prob)))
