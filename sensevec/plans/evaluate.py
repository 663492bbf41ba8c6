"""Sense-induction evaluation over one or several data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, wsi
from ..operators.model import SenseModel
from ..operators.score import broadcast_decoder
from ..session import materialize
from ..sources.nested import read_nested
from ..sources.wsi import read_answers, read_contexts


def evaluate_instances(instances: DataFrame, answers: DataFrame, model: SenseModel, window: int = 5) -> DataFrame:
    """One summary row per data set.

    ``instances`` is ``(dataset, key, instance, left, right)``, ``answers`` is ``(dataset, key, instance, sense)``.
    """
    decoder = broadcast_decoder(model)
    named = F.concat_ws("\t", "key", "dataset")
    predicted = wsi.predict(instances.withColumn("key", named), model, window, decoder)
    labels = metrics.align(answers.withColumn("key", named), predicted)
    split = F.split("key", "\t")
    labels = labels.select(split[1].alias("dataset"), split[0].alias("key"), "truth", "pred")
    return metrics.summary(labels, "key", "dataset")


def evaluate_weighted(rows: DataFrame, model: SenseModel, window: int = 5, stop_words: DataFrame | None = None) -> DataFrame:
    """``(words, mean_ari)`` of weighted rows with ``record`` and ``sense_no``: every record of enough weight counts once."""
    return wsi.mean_ari(rows, model, window, stop_words, decoder=broadcast_decoder(model), max_contexts=MOST_CONTEXTS)


# Contexts of a sense that the weighted evaluation scores, as its published form does.
MOST_CONTEXTS = 500


def evaluation_job(
    spark: SparkSession,
    model: SenseModel,
    labelled: dict[str, tuple[str, str]],
    weighted: dict[str, str],
    window: int = 5,
) -> DataFrame:
    """One row per data set: the summary of labelled ones, ``words`` and ``mean_ari`` of weighted ones.

    ``labelled`` names pairs of a context file and an answer file, ``weighted`` files in the nested line format.
    """
    parts = []
    for name, (contexts, answers) in labelled.items():
        data = F.lit(name).alias("dataset")
        instances, truth = read_contexts(spark, contexts).select(data, "*"), read_answers(spark, answers).select(data, "*")
        parts.append(evaluate_instances(materialize(instances, "instances"), truth, model, window))
    for name, path in weighted.items():
        rows = materialize(read_nested(spark, path), "weighted")
        parts.append(evaluate_weighted(rows, model, window).select(F.lit(name).alias("dataset"), "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
