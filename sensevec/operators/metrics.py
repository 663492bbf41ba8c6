"""Agreement of two labellings: adjusted Rand index, V-measure, paired F-score.

All three come from one small table of cell, row and column totals; no pair of instances is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(labels: DataFrame, *keys: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """``(keys, truth, pred, n)``."""
    named = labels.select(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred"))
    return named.groupBy(*keys, "truth", "pred").agg(F.count("*").alias("n"))


def align(truth: DataFrame, predictions: DataFrame, *datasets: str) -> DataFrame:
    """Meet both labellings on (key, instance), whatever order they were written in."""
    keys = [*datasets, "key", "instance"]
    return truth.select(*keys, F.col("sense").alias("truth")).join(
        predictions.select(*keys, F.col("sense").alias("pred")), keys
    )


def _pairs(n: Column) -> Column:
    n = n.cast("double")  # the product of two large counts does not fit a bigint
    return n * (n - 1) / F.lit(2.0)


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.ln(n.cast("double"))).otherwise(F.lit(0.0))


def totals(cells: DataFrame, *keys: str) -> DataFrame:
    """Per key: instances, label counts, pair sums and entropy sums of cells, rows and columns."""
    sets = [[*keys, "truth", "pred"], [*keys, "truth"], [*keys, "pred"]]
    level = F.grouping_id()
    margins = (
        cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, "truth", "pred")])
        .agg(F.sum("n").alias("n"), level.alias("level"))
    )
    # the last two bits of the level tell which label was summed away
    kind = F.col("level").bitwiseAND(3)
    n = F.col("n")
    part = {"cell": kind == 0, "truth": kind == 1, "pred": kind == 2}
    sums = []
    for name, chosen in part.items():
        sums.append(F.sum(F.when(chosen, _pairs(n)).otherwise(0.0)).alias(f"{name}_pairs"))
        sums.append(F.sum(F.when(chosen, _n_log_n(n)).otherwise(0.0)).alias(f"{name}_nlogn"))
        sums.append(F.count_if(chosen).alias(f"{name}_labels"))
    return margins.groupBy(*keys).agg(F.sum(F.when(part["cell"], n).otherwise(0)).alias("n"), *sums)


def ari_column(equal: Column | None = None) -> Column:
    """Adjusted Rand index; NULL where it is not defined, or ``equal`` if both labellings agree there."""
    index, a, b = F.col("cell_pairs"), F.col("truth_pairs"), F.col("pred_pairs")
    expected = F.try_divide(a * b, _pairs(F.col("n")))
    ari = F.try_divide(index - expected, (a + b) / 2 - expected)
    if equal is None:
        return ari
    return F.when((index == a) & (index == b), equal).otherwise(ari)


def v_measure_column() -> Column:
    """Harmonic mean of homogeneity and completeness."""
    n = F.col("n").cast("double")

    def entropy(name: str) -> Column:
        return F.ln(n) - F.col(f"{name}_nlogn") / n

    h_truth, h_pred = entropy("truth"), entropy("pred")
    mutual = F.greatest(h_truth + h_pred - entropy("cell"), F.lit(0.0))
    h = F.when(F.col("truth_labels") == 1, F.lit(1.0)).otherwise(F.try_divide(mutual, h_truth))
    c = F.when(F.col("pred_labels") == 1, F.lit(1.0)).otherwise(F.try_divide(mutual, h_pred))
    return F.coalesce(F.try_divide(2 * h * c, h + c), F.lit(0.0))


def paired_fscore_column() -> Column:
    """F-score over pairs of instances with equal labels; NULL if a labelling has no such pair."""
    p = F.try_divide(F.col("cell_pairs"), F.col("pred_pairs"))
    r = F.try_divide(F.col("cell_pairs"), F.col("truth_pairs"))
    return F.try_divide(2 * p * r, p + r)


def scores(labels: DataFrame, *keys: str) -> DataFrame:
    """``(keys, n, truth_labels, ari, v, f)`` per key; the index of one-label keys is NULL."""
    many = F.col("truth_labels") > 1
    return totals(contingency(labels, *keys), *keys).select(
        *keys,
        "n",
        "truth_labels",
        F.when(many, ari_column(F.lit(1.0))).alias("ari"),
        v_measure_column().alias("v"),
        paired_fscore_column().alias("f"),
    )


def ari(labels: DataFrame, *keys: str) -> DataFrame:
    return totals(contingency(labels, *keys), *keys).select(*keys, ari_column().alias("ari"))


def ari_by_key(labels: DataFrame, *keys: str) -> DataFrame:
    return scores(labels, *keys).filter(F.col("truth_labels") > 1).select(*keys, "ari")


def v_measure(labels: DataFrame, *keys: str) -> DataFrame:
    return scores(labels, *keys).select(*keys, "v")


def paired_fscore(labels: DataFrame, *keys: str) -> DataFrame:
    return scores(labels, *keys).select(*keys, "f")


def summary(labels: DataFrame, key: str = "key", *datasets: str) -> DataFrame:
    """One row per data set: one-sense keys, plain means, and means weighted by instances."""
    per_key = scores(labels, *datasets, key)

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum(F.when(F.col(c).isNotNull(), F.col("n"))))

    return per_key.groupBy(*datasets).agg(
        F.count_if(F.col("truth_labels") <= 1).alias("one_sense_keys"),
        F.avg("ari").alias("mean_ari"),
        F.avg("v").alias("mean_v"),
        weighted("v").alias("weighted_v"),
        F.avg("f").alias("mean_f"),
        weighted("f").alias("weighted_f"),
    )
