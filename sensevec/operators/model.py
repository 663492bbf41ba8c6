"""Model tables: random, zero and count initialisation, saving, loading, shape."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mixer import uniform
from ..functions.priors import expected_pi
from ..functions.vectors import unit
from .huffman import huffman_tree
from .versions import KEEP, latest, publish

IN_TABLE, OUT_TABLE = 1, 2  # the ``id2`` offset that keeps both random streams apart


@dataclass(frozen=True)
class SenseModel:
    """``vocab(word_id, word, freq)``, ``tree(word_id, depth, node_id, code)``,
    ``in_vec(word_id, sense, vec)``, ``out_vec(node_id, vec)``, ``sense_counts(word_id, counts)``."""

    vocab: DataFrame
    tree: DataFrame
    in_vec: DataFrame
    out_vec: DataFrame
    sense_counts: DataFrame
    alpha: float
    d: float
    dim: int
    senses: int

    TABLES = ("vocab", "tree", "in_vec", "out_vec", "sense_counts")

    def with_tables(self, **tables: DataFrame) -> SenseModel:
        return replace(self, **tables)


def random_vector(key, slot: int | object, dim: int, seed: int, scale: float):
    """Uniform in ``(-scale/2, scale/2)`` per element, a function of the keys only."""
    cells = F.sequence(F.lit(0), F.lit(dim - 1))
    return F.transform(cells, lambda i: ((uniform(key, slot, i, seed) - F.lit(0.5)) * F.lit(scale)).cast("float"))


def init_in(vocab: DataFrame, dim: int, senses: int, seed: int = 1, scale: float | None = None) -> DataFrame:
    rows = vocab.select("word_id", F.explode(F.sequence(F.lit(1), F.lit(senses))).alias("sense"))
    vec = random_vector(F.col("word_id"), F.col("sense"), dim, seed, 1.0 / dim if scale is None else scale)
    return rows.select("word_id", "sense", vec.alias("vec"))


def init_out(vocab: DataFrame, dim: int, seed: int = 1, scale: float | None = None) -> DataFrame:
    """One vector per inner node ``1..V-1``; the random stream is that of slot 0."""
    vec = random_vector(F.col("node_id"), 0, dim, seed, 1.0 / dim if scale is None else scale)
    # ids are dense from 1, so every word but the first names one node
    nodes = vocab.filter(F.col("word_id") > 1).select((F.col("word_id") - 1).alias("node_id"))
    return nodes.select("node_id", vec.alias("vec"))


def init_counts(vocab: DataFrame, senses: int, init_count: float = -1.0) -> DataFrame:
    """Everything on the first sense: ``init_count`` if positive, else the word's frequency."""
    first = F.lit(float(init_count)) if init_count > 0 else F.col("freq").cast("double")
    ks = F.sequence(F.lit(1), F.lit(senses))
    return vocab.select(
        "word_id", F.transform(ks, lambda k: F.when(k == 1, first).otherwise(F.lit(0.0))).alias("counts")
    )


def new_model(
    vocab: DataFrame,
    dim: int,
    senses: int,
    alpha: float = 0.1,
    d: float = 0.0,
    seed: int = 1,
    init_count: float = -1.0,
) -> SenseModel:
    return SenseModel(
        vocab=vocab,
        tree=huffman_tree(vocab),
        in_vec=init_in(vocab, dim, senses, seed),
        out_vec=init_out(vocab, dim, seed),
        sense_counts=init_counts(vocab, senses, init_count),
        alpha=alpha,
        d=d,
        dim=dim,
        senses=senses,
    )


def zero_model(vocab: DataFrame, dim: int, senses: int, alpha: float = 0.1, d: float = 0.0) -> SenseModel:
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim).alias("vec")
    in_rows = vocab.select("word_id", F.explode(F.sequence(F.lit(1), F.lit(senses))).alias("sense"))
    nodes = vocab.filter(F.col("word_id") > 1).select((F.col("word_id") - 1).alias("node_id"))
    return SenseModel(
        vocab=vocab,
        tree=huffman_tree(vocab),
        in_vec=in_rows.select("word_id", "sense", zeros),
        out_vec=nodes.select("node_id", zeros),
        sense_counts=vocab.select("word_id", F.array_repeat(F.lit(0.0), senses).alias("counts")),
        alpha=alpha,
        d=d,
        dim=dim,
        senses=senses,
    )


def sense_priors(model: SenseModel) -> DataFrame:
    """``(word_id, pi)`` for the whole vocabulary."""
    return model.sense_counts.select("word_id", expected_pi(F.col("counts"), model.alpha, model.d).alias("pi"))


def sense_inventory(model: SenseModel, min_prob: float = 0.0) -> DataFrame:
    """``(word, sense, p)`` of every word at once."""
    rows = sense_priors(model).select("word_id", F.posexplode("pi").alias("k", "p"))
    rows = rows.select("word_id", (F.col("k") + 1).alias("sense"), "p").filter(F.col("p") >= min_prob)
    return rows.join(model.vocab.select("word_id", "word"), "word_id").select("word_id", "word", "sense", "p")


def pruned_in(model: SenseModel, min_prob: float = 1e-5) -> DataFrame:
    """Sense vectors whose prior is at least ``min_prob``; counts are not touched by pruning."""
    kept = sense_priors(model).select("word_id", F.posexplode("pi").alias("k", "p"))
    kept = kept.filter(F.col("p") >= min_prob).select("word_id", (F.col("k") + 1).alias("sense"))
    return model.in_vec.join(kept, ["word_id", "sense"])


def save_model(model: SenseModel, path: str, min_prob: float = 1e-5, keep: int = KEEP) -> int:
    """Publish the model as a new version under ``path``: one Parquet folder per table, then the log entry that names them.

    A model that was there before stays readable until the entry is written; the last ``keep`` versions are kept.
    """
    spark = model.vocab.sparkSession
    tables = {name: getattr(model, name) for name in model.TABLES}
    tables["in_vec"] = pruned_in(model, min_prob)

    def write(folder: str) -> None:
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")

    meta = spark.createDataFrame(
        [(model.alpha, model.d, model.dim, model.senses)], "alpha double, d double, dim int, senses int"
    )
    return publish(spark, path, write, meta, keep)


def load_model(spark: SparkSession, path: str) -> SenseModel:
    """The newest published version.  Pruned senses simply have no ``in_vec`` row."""
    meta = latest(spark, path)
    tables = {name: spark.read.parquet(f"{meta['at']}/{name}") for name in SenseModel.TABLES}
    return SenseModel(**tables, alpha=meta["alpha"], d=meta["d"], dim=meta["dim"], senses=meta["senses"])


def model_shape(model: SenseModel) -> DataFrame:
    """``(dim, senses, words)`` as found in the tables."""
    return model.in_vec.agg(
        F.max(F.size("vec")).alias("dim"),
        F.max("sense").alias("senses"),
        F.count_distinct("word_id").alias("words"),
    )


def sense_vector(model: SenseModel, words: DataFrame) -> DataFrame:
    """Raw vectors of ``(word, sense)`` rows, with the unit vector beside them."""
    ids = words.join(model.vocab.select("word", "word_id"), "word")
    return ids.join(model.in_vec, ["word_id", "sense"]).withColumn("unit", unit(F.col("vec")))
