"""Vector algebra on array columns, and the scalar functions of the model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The asymptotic series of digamma, coefficients of y^-2, y^-4, ...
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
DIGAMMA_SHIFT = 6


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """``-log(1 + exp(-x))`` without overflow for large negative ``x``."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def digamma(x: Column) -> Column:
    """Digamma for positive arguments: shift up by the recurrence, then the asymptotic series."""
    y = x + F.lit(float(DIGAMMA_SHIFT))
    inv2 = F.lit(1.0) / (y * y)
    tail = F.lit(0.0)
    for coefficient in reversed(DIGAMMA_SERIES):
        tail = (tail + F.lit(coefficient)) * inv2
    shift = sum((F.lit(1.0) / (x + F.lit(float(i))) for i in range(DIGAMMA_SHIFT)), F.lit(0.0))
    return F.ln(y) - F.lit(0.5) / y + tail - shift


def mean_beta(a: Column, b: Column) -> Column:
    return a / (a + b)


def meanlog_beta(a: Column, b: Column) -> Column:
    return digamma(a) - digamma(a + b)


def mean_mirror(a: Column, b: Column) -> Column:
    return mean_beta(b, a)


def meanlog_mirror(a: Column, b: Column) -> Column:
    return meanlog_beta(b, a)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain reference inside a lambda would be
    evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e.cast("double"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, e: acc + e)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double")))


def unit(v: Column) -> Column:
    """``v`` divided by its length; NULL for a zero vector."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda e: e.cast("double") / n)))


def cos_dist(a: Column, b: Column) -> Column:
    """One minus the cosine; NULL when either vector has length zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def softmax(v: Column) -> Column:
    """Normalised exponentials; NULL when no entry is finite, so no NaN leaves this function."""

    def shifted(e: Column) -> Column:
        return let(F.array_max(e), lambda top: F.transform(e, lambda x: F.exp(x - top)))

    def scaled(s: Column) -> Column:
        return let(array_total(s), lambda total: F.transform(s, lambda x: x / total))

    return let(v, lambda e: F.when(F.array_max(e) > F.lit(float("-inf")), scaled(shifted(e))))


def log_or_neg_inf(p: Column, min_prob: float) -> Column:
    """``ln p``, or minus infinity for a probability below ``min_prob``."""
    return F.when((p < F.lit(min_prob)) | (p <= 0), F.lit(float("-inf"))).otherwise(F.ln(p))


def weighted_logsumexp(ll: Column, pi: Column, min_prob: float) -> Column:
    """``log sum_k pi_k exp(ll_k)`` over the senses with ``pi_k >= min_prob``; NULL if there is none."""
    terms = F.zip_with(ll, pi, lambda a, p: a + log_or_neg_inf(p, min_prob))

    def reduced(e: Column) -> Column:
        return let(
            F.array_max(e),
            lambda top: F.when(
                top > F.lit(float("-inf")), top + F.ln(array_total(F.transform(e, lambda t: F.exp(t - top))))
            ),
        )

    return let(terms, reduced)
