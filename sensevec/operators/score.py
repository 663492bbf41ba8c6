"""Likelihoods of word pairs, sense posteriors of occurrences, likelihood of text.

Every operator has two physical forms.  If node vectors and paths fit a broadcast of checked size, tasks score
whole groups of rows with matrix products.  Otherwise dot products are computed once per
(word, sense, node) in joins and summed over paths by shuffles; no side of these has to be small.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.priors import expected_logpi, expected_pi
from ..functions.vectors import dot, log_or_neg_inf, log_sigmoid, softmax, weighted_logsumexp
from ..session import materialize
from .kernel import (
    context_scorer,
    flat_pair_scorer,
    group_averager,
    mixture_averager,
    occurrence_scorer,
    pair_averager,
    pair_scorer,
    pair_valuer,
    posterior_scorer,
)
from .model import SenseModel, sense_priors
from .skew import sliced

BROADCAST_BYTES = 256 << 20
SIDE_BYTES = 64 << 20
SLICE_ROWS = 1024
PARTNERS = 65_536


def fits_broadcast(model: SenseModel, limit: int | None = None) -> bool:
    """Whether node vectors and paths stay below ``limit`` bytes, from the number of words."""
    words = model.vocab.count()
    steps = words * (math.log2(words + 2) + 2)
    return words * model.dim * 4 + steps * 5 <= (BROADCAST_BYTES if limit is None else limit)


def broadcast_decoder(
    model: SenseModel, limit: int | None = None, paths: tuple[np.ndarray, ...] | None = None
) -> Broadcast | None:
    """Node vectors and paths for the tasks, or None when they would exceed ``limit`` bytes.

    ``paths`` are those of an earlier call: they stay the same while the vectors change.
    """
    if not fits_broadcast(model, limit):
        return None
    start, node, code = paths or collect_paths(model)
    # plain arrays, because workers need not have this package
    return model.vocab.sparkSession.sparkContext.broadcast((collect_nodes(model, len(start) - 1), start, node, code))


def collect_nodes(model: SenseModel, size: int) -> np.ndarray:
    """Node vectors by id."""
    nodes = model.out_vec.select("node_id", "vec").toArrow()
    out = np.zeros((size, model.dim), dtype=np.float32)
    if nodes.num_rows:
        flat = nodes.column("vec").combine_chunks().flatten().to_numpy()
        out[nodes.column("node_id").to_numpy()] = flat.reshape(-1, model.dim)
    return out


def collect_paths(model: SenseModel) -> tuple[np.ndarray, ...]:
    """Where the path of each word starts, and the nodes and codes of all paths."""
    tree = model.tree.select("word_id", "depth", "node_id", "code").toArrow()
    word, depth = tree.column("word_id").to_numpy(), tree.column("depth").to_numpy()
    order = np.lexsort((depth, word))
    start = np.zeros(model.vocab.count() + 2, dtype=np.int64)
    np.add.at(start, word + 1, 1)
    return np.cumsum(start), tree.column("node_id").to_numpy()[order], tree.column("code").to_numpy()[order]


def side_fits(model: SenseModel) -> bool:
    """Whether vectors and starting values of all words stay below ``SIDE_BYTES``, from the number of words."""
    return (model.vocab.count() + 1) * model.senses * (model.dim * 4 + 8) <= SIDE_BYTES


def broadcast_words(model: SenseModel, prior: str, min_prob: float = 1e-3) -> Broadcast | None:
    """Vectors and starting values (see :func:`start_scores`) of all words for the tasks, or None above ``SIDE_BYTES``.

    With them rows are scored wherever they are, in any order, and none is shuffled by word.
    """
    if not side_fits(model):
        return None
    size = model.vocab.count() + 1
    vecs = np.zeros((size, model.senses, model.dim), dtype=np.float32)
    start = np.full((size, model.senses), np.nan)
    begun = np.zeros(size, dtype=bool)  # a start that is not a number is no unknown word, but a model that has diverged
    present = np.zeros((size, model.senses), dtype=bool)
    rows = model.in_vec.select("word_id", "sense", "vec").toArrow()
    if rows.num_rows:
        at = rows.column("word_id").to_numpy(), rows.column("sense").to_numpy() - 1
        vecs[at] = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, model.dim)
        present[at] = True
    n_senses = np.zeros(size, dtype=np.int64)
    begin = start_scores(model, prior, min_prob).toArrow()
    if begin.num_rows:
        flat = begin.column("start_z").combine_chunks().flatten().to_numpy()
        start[begin.column("word_id").to_numpy()] = flat.reshape(-1, model.senses)
        begun[begin.column("word_id").to_numpy()] = True
        n_senses[begin.column("word_id").to_numpy()] = begin.column("n_senses").to_numpy()
    base = np.where(present, start, -np.inf)
    base[~begun | ~present.any(axis=1)] = np.inf
    return model.vocab.sparkSession.sparkContext.broadcast((vecs, base, {}, n_senses))


def packed_pairs(pairs: DataFrame, model: SenseModel) -> DataFrame:
    """``(x, vecs, pi, ps)``: the partners of a word as one array beside its sense vectors and priors.

    Pairs are distinct, so a word has at most V partners; a large vocabulary is cut into slices of
    about ``PARTNERS`` words, which bounds the array.
    """
    n = F.col("n") if "n" in pairs.columns else F.lit(1).cast("bigint")
    slices = max(1, math.ceil(model.vocab.count() / PARTNERS))
    rows = pairs.select("x", F.pmod("y", F.lit(slices)).alias("slice"), F.struct("y", n.alias("n")).alias("p"))
    packed = rows.groupBy("x", "slice").agg(F.collect_list("p").alias("ps"))
    vecs = model.in_vec.groupBy("word_id").agg(F.collect_list(F.struct("sense", "vec")).alias("vecs"))
    side = vecs.join(sense_priors(model), "word_id").withColumnRenamed("word_id", "x")
    return packed.join(side, "x").select("x", "vecs", "pi", "ps")


def pair_loglik(pairs: DataFrame, model: SenseModel, decoder: Broadcast | None = None) -> DataFrame:
    """``(x, y, n, ll)`` for distinct pairs: ``ll[k]`` is the log-probability of ``y`` given sense ``k`` of ``x``.

    A sense without a vector gets minus infinity.
    """
    decoder = decoder or broadcast_decoder(model)
    if decoder is None:
        return pair_loglik_joined(pairs, model)
    schema = "x int, y int, n bigint, ll array<double>"
    side = broadcast_words(model, "none")
    if side is not None:
        n = F.col("n") if "n" in pairs.columns else F.lit(1).cast("bigint")
        return pairs.select("x", "y", n.alias("n")).mapInArrow(flat_pair_scorer(decoder, side), schema)
    return packed_pairs(pairs, model).mapInArrow(pair_scorer(decoder, model.senses), schema)


def node_scores(pairs: DataFrame, model: SenseModel) -> DataFrame:
    """``(x, node_id, sense, f)``: one dot product per distinct word, node and sense."""
    tree = model.tree.select(F.col("word_id").alias("y"), "node_id")
    needed = pairs.select("x", "y").join(tree, "y").select("x", "node_id").distinct()
    vectors = model.in_vec.select(F.col("word_id").alias("x"), "sense", "vec")
    nodes = model.out_vec.select("node_id", F.col("vec").alias("node_vec"))
    joined = needed.join(nodes, "node_id").join(vectors, "x")
    return joined.select("x", "node_id", "sense", dot(F.col("vec"), F.col("node_vec")).alias("f"))


def pair_loglik_joined(pairs: DataFrame, model: SenseModel) -> DataFrame:
    """:func:`pair_loglik` without any broadcast of model data."""
    if "n" not in pairs.columns:
        pairs = pairs.withColumn("n", F.lit(1).cast("bigint"))
    # the senses of one (x, node) travel as one map, so the sum over a path is one aggregation per pair
    scores = node_scores(pairs, model).groupBy("x", "node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("sense", "f"))).alias("fs")
    )
    steps = pairs.join(model.tree.select(F.col("word_id").alias("y"), "node_id", "code"), "y")
    terms = steps.join(scores, ["x", "node_id"])
    sign = F.lit(1.0) - F.lit(2.0) * F.col("code")
    sums = [
        F.sum(log_sigmoid(F.try_element_at("fs", F.lit(k)) * sign)).alias(f"ll{k}")
        for k in range(1, model.senses + 1)
    ]
    summed = terms.groupBy("x", "y").agg(F.max("n").alias("n"), *sums)
    missing = F.lit(float("-inf"))
    ll = F.array(*[F.coalesce(F.col(f"ll{k}"), missing) for k in range(1, model.senses + 1)])
    return summed.select("x", "y", "n", ll.alias("ll"))


def log_skip_gram(pairs: DataFrame, model: SenseModel, decoder: Broadcast | None = None) -> DataFrame:
    """:func:`pair_loglik` in long form: ``(x, sense, y, ll)``."""
    rows = pair_loglik(pairs, model, decoder).select("x", "y", F.posexplode("ll").alias("k", "ll"))
    return rows.filter(F.col("ll") > F.lit(float("-inf"))).select("x", (F.col("k") + 1).alias("sense"), "y", "ll")


def context_loglik(occurrences: DataFrame, model: SenseModel, decoder: Broadcast | None = None) -> DataFrame:
    """``(occ_id, sense, ll)``: the log-likelihood of a whole context under each sense."""
    decoder = decoder or broadcast_decoder(model)
    side = broadcast_words(model, "none") if decoder is not None else None
    if side is not None:
        occ_type = occurrences.schema["occ_id"].dataType.simpleString()
        kernel = context_scorer(decoder, side)
        scored = occurrences.select("occ_id", "x", "ctx").mapInArrow(kernel, f"occ_id {occ_type}, ll array<double>")
        rows = scored.select("occ_id", F.posexplode("ll").alias("k", "ll")).filter(F.col("ll") > F.lit(float("-inf")))
        return rows.select("occ_id", (F.col("k") + 1).alias("sense"), "ll")
    occurrences = materialize(occurrences, "occurrences")  # read twice below
    pairs = occurrences.select("occ_id", "x", F.explode("ctx").alias("y"))
    scores = pair_loglik(pairs.select("x", "y").distinct(), model, decoder).drop("n")
    sums = [F.sum(F.col("ll")[k]).alias(f"ll{k + 1}") for k in range(model.senses)]
    summed = pairs.join(scores, ["x", "y"]).groupBy("occ_id").agg(*sums)
    entries = F.array(*[F.struct(F.lit(k).alias("sense"), F.col(f"ll{k}").alias("ll")) for k in range(1, model.senses + 1)])
    return summed.select("occ_id", F.inline(entries)).filter(F.col("ll") > F.lit(float("-inf")))


def start_scores(model: SenseModel, prior: str, min_prob: float = 1e-3) -> DataFrame:
    """``(word_id, start_z, n_senses)``: what the posterior of a word starts from.

    ``prior`` is ``pi`` for queries (log of the expected prior, negligible senses ruled out), ``logpi`` for
    training (expected log prior) or ``none``.
    """
    pi = expected_pi(F.col("counts"), model.alpha, model.d)
    if prior == "pi":
        start = F.transform(pi, lambda p: log_or_neg_inf(p, min_prob))
    elif prior == "logpi":
        start = expected_logpi(F.col("counts"), model.alpha, model.d)
    elif prior == "none":
        start = F.array_repeat(F.lit(0.0), model.senses)
    else:
        raise ValueError(prior)
    return model.sense_counts.select(
        "word_id", start.alias("start_z"), F.size(F.filter(pi, lambda p: p >= 1e-3)).alias("n_senses")
    )


def word_side(model: SenseModel, prior: str, min_prob: float = 1e-3) -> DataFrame:
    """``(x, vecs, start_z, n_senses)``: everything about a centre word in one row."""
    vecs = model.in_vec.groupBy("word_id").agg(F.collect_list(F.struct("sense", "vec")).alias("vecs"))
    return vecs.join(start_scores(model, prior, min_prob), "word_id").withColumnRenamed("word_id", "x")


def meet_side(groups: DataFrame, side: DataFrame, model: SenseModel, written: bool = False) -> DataFrame:
    """Groups ``(x, slice, ...)`` beside the row of their word in ``side``.

    If the vectors of all words stay below ``SIDE_BYTES`` the side is broadcast, and groups stay where they were built.  Otherwise a word's
    row is repeated once per slice and meets the groups by word and slice, so a hot word spreads over as many tasks as it has
    slices and no rows are shuffled by word alone.  Groups are written before, unless they come from a table (``written``).
    """
    size = model.vocab.count() * (model.senses * (model.dim + 3) + 4) * 8
    if size <= SIDE_BYTES:
        return groups.drop("slice").join(F.broadcast(side), "x")
    groups = groups if written else materialize(groups, "slices")
    slices = groups.groupBy("x").agg((F.max("slice") + 1).alias("slices"))
    repeated = side.join(slices, "x").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    return groups.join(repeated.drop("slices"), ["x", "slice"]).drop("slice")


def slice_occurrences(occurrences: DataFrame) -> DataFrame:
    """``(x, slice, occs)`` groups of bounded size from ``(occ_id, x, ctx)`` rows.

    A ``freq`` column with the number of rows of the word, or more, spares counting them.  A ``behind`` column goes along.
    """
    extra = ["behind"] if "behind" in occurrences.columns else []
    count = F.col("freq") if "freq" in occurrences.columns else None
    cut = sliced(occurrences, "x", ["occ_id"], SLICE_ROWS, count)
    return cut.groupBy("x", "slice").agg(F.collect_list(F.struct("occ_id", "ctx", *extra)).alias("occs"))


def posteriors(
    occurrences: DataFrame,
    model: SenseModel,
    prior: str = "pi",
    min_prob: float = 1e-3,
    decoder: Broadcast | None = None,
) -> DataFrame:
    """``(occ_id, z)`` for ``(occ_id, x, ctx)`` rows; ``z`` is NULL when every sense is ruled out."""
    decoder = decoder or broadcast_decoder(model)
    if decoder is None:
        return posteriors_joined(occurrences, model, prior, min_prob)
    occ_type = occurrences.schema["occ_id"].dataType.simpleString()
    side = broadcast_words(model, prior, min_prob)
    if side is not None:
        kernel = occurrence_scorer(decoder, side)
        return occurrences.select("occ_id", "x", "ctx").mapInArrow(kernel, f"occ_id {occ_type}, z array<double>")
    slices = meet_side(slice_occurrences(occurrences), word_side(model, prior, min_prob), model)
    return slices.select("vecs", "start_z", "occs").mapInArrow(
        posterior_scorer(decoder, model.senses), f"occ_id {occ_type}, z array<double>"
    )


def posteriors_joined(
    occurrences: DataFrame, model: SenseModel, prior: str = "pi", min_prob: float = 1e-3
) -> DataFrame:
    """:func:`posteriors` by joins: score distinct pairs, join them back to the occurrences and sum."""
    pairs = occurrences.select("occ_id", "x", F.explode("ctx").alias("y"))
    scores = pair_loglik_joined(pairs.select("x", "y").distinct(), model).drop("n")
    sums = [F.sum(F.col("ll")[k]).alias(f"ll{k}") for k in range(model.senses)]
    summed = pairs.join(scores, ["x", "y"]).groupBy("occ_id").agg(*sums)
    summed = summed.select("occ_id", F.array(*[f"ll{k}" for k in range(model.senses)]).alias("ll"))
    present = model.in_vec.groupBy("word_id").agg(F.collect_set("sense").alias("present"))
    start = start_scores(model, prior, min_prob).join(present, "word_id").withColumnRenamed("word_id", "x")
    rows = occurrences.select("occ_id", "x").join(start, "x").join(summed, "occ_id", "left")
    gone = F.lit(float("-inf"))
    masked = F.transform(
        "start_z", lambda e, k: F.when(F.array_contains(F.col("present"), (k + 1).cast("int")), e).otherwise(gone)
    )
    z = F.when(F.col("ll").isNull(), masked).otherwise(F.zip_with(masked, F.col("ll"), lambda a, b: a + b))
    return rows.select("occ_id", softmax(z).alias("z"))


def disambiguate(
    occurrences: DataFrame,
    model: SenseModel,
    use_prior: bool = True,
    min_prob: float = 1e-3,
    decoder: Broadcast | None = None,
) -> DataFrame:
    """Sense posterior of words in contexts, for a whole table of them."""
    return posteriors(occurrences, model, "pi" if use_prior else "none", min_prob, decoder)


def disambiguate_words(
    requests: DataFrame, model: SenseModel, use_prior: bool = True, min_prob: float = 1e-3
) -> DataFrame:
    """The same for ``(occ_id, word, context array<string>)``; unknown words are dropped on both sides."""
    ids = model.vocab.select("word", "word_id")
    targets = requests.join(ids, "word").select("occ_id", F.col("word_id").alias("x"))
    around = requests.select("occ_id", F.posexplode("context").alias("i", "word")).join(ids, "word")
    ctx = around.groupBy("occ_id").agg(F.sort_array(F.collect_list(F.struct("i", "word_id"))).alias("c"))
    ctx = ctx.select("occ_id", F.col("c.word_id").alias("ctx"))
    empty = F.array().cast("array<int>")
    occurrences = targets.join(ctx, "occ_id", "left").withColumn("ctx", F.coalesce("ctx", empty))
    return disambiguate(occurrences, model, use_prior, min_prob)


def argmax_sense(posterior: DataFrame) -> DataFrame:
    """``(occ_id, sense)``: the most probable sense, the first one on a tie."""
    best = F.array_position("z", F.array_max("z")).cast("int")
    return posterior.filter(F.col("z").isNotNull()).select("occ_id", best.alias("sense"))


def pair_values(
    pairs: DataFrame, model: SenseModel, min_prob: float = 1e-5, decoder: Broadcast | None = None
) -> DataFrame:
    """``(x, y, n, v)``: ``v = log sum_k pi_k p(y | x, k)`` over the senses that matter; pairs without such a sense are left out."""
    decoder = decoder or broadcast_decoder(model)
    if decoder is None:
        scored = pair_loglik_joined(pairs, model)
        priors = sense_priors(model).withColumnRenamed("word_id", "x")
        v = weighted_logsumexp(F.col("ll"), F.col("pi"), min_prob)
        return scored.join(priors, "x").select("x", "y", "n", v.alias("v")).filter("v is not null")
    return packed_pairs(pairs, model).mapInArrow(
        pair_valuer(decoder, min_prob), "x int, y int, n bigint, v double"
    )


def likelihood(
    pairs: DataFrame, model: SenseModel, min_prob: float = 1e-5, decoder: Broadcast | None = None
) -> DataFrame:
    """``(mean, n)`` over pairs ``(x, y, n)`` counted in any parts; no pairs give ``(0, 0)``."""
    decoder = decoder or broadcast_decoder(model)
    side = broadcast_words(model, "pi", min_prob) if decoder is not None else None
    if side is not None:
        sums = pairs.select("x", "y", "n").mapInArrow(mixture_averager(decoder, side, []), "s double, n bigint")
        return merge_sums(sums)
    pairs = pairs.groupBy("x", "y").agg(F.sum("n").alias("n"))  # the other forms take each pair once
    if decoder is None:
        return weighted_mean(pair_values(pairs, model, min_prob))
    # only one mean per packed row leaves the tasks
    means = packed_pairs(pairs, model).mapInArrow(pair_averager(decoder, min_prob), "mean double, n bigint")
    return merge_means(means)


def weighted_mean(values: DataFrame, *keys: str) -> DataFrame:
    total = F.sum("n")
    mean = F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("v")), total), F.lit(0.0))
    return values.groupBy(*keys).agg(mean.alias("mean"), F.coalesce(total, F.lit(0)).alias("n"))


def merge_sums(sums: DataFrame, *keys: str) -> DataFrame:
    """``(keys, mean, n)`` of partial sums ``(keys, s, n)``."""
    mean = F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0))
    return sums.groupBy(*keys).agg(mean.alias("mean"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def likelihood_by(
    counted: DataFrame,
    model: SenseModel,
    *keys: str,
    min_prob: float = 1e-5,
    decoder: Broadcast | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """``(keys, mean, n)`` over pairs counted within ``keys``; groups without a pair get ``(0, 0)`` if ``groups (keys)`` names them.

    Where the vectors of all words fit a broadcast, pairs are scored where they are and one sum per batch and group leaves a task.
    Otherwise they meet the vectors of their first word once, in slices of bounded size that carry the group of each pair.  The join form scores distinct pairs and joins them back.
    """
    decoder = decoder or broadcast_decoder(model)
    if decoder is None:
        counted = materialize(counted, "counted-pairs")
        values = pair_values(counted.select("x", "y").distinct(), model, min_prob).drop("n")
        found = weighted_mean(counted.join(values, ["x", "y"]), *keys)
    elif (side := broadcast_words(model, "pi", min_prob)) is not None:
        fields = ", ".join(f"`{k}` {counted.schema[k].dataType.simpleString()}" for k in keys)
        kernel = mixture_averager(decoder, side, list(keys))
        found = merge_sums(counted.select(*keys, "x", "y", "n").mapInArrow(kernel, f"{fields}, s double, n bigint"), *keys)
    else:
        counted = materialize(counted, "counted-pairs")
        cut = sliced(counted, "x", [*keys, "y"], PARTNERS)
        packed = cut.groupBy("x", "slice").agg(F.collect_list(F.struct(*keys, "y", "n")).alias("ps"))
        vecs = model.in_vec.groupBy("word_id").agg(F.collect_list(F.struct("sense", "vec")).alias("vecs"))
        side = vecs.join(sense_priors(model), "word_id").withColumnRenamed("word_id", "x")
        rows = meet_side(packed, side, model).select("vecs", "pi", "ps")
        fields = ", ".join(f"`{k}` {counted.schema[k].dataType.simpleString()}" for k in keys)
        partial = rows.mapInArrow(group_averager(decoder, min_prob, list(keys)), f"{fields}, s double, n bigint")
        found = merge_sums(partial, *keys)
    if groups is None:
        return found
    filled = groups.select(*keys).distinct().join(found, list(keys), "left")
    return filled.select(*keys, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def merge_means(stats: DataFrame, *keys: str) -> DataFrame:
    """Mean of batch means ``(mean, n)``, weighted by batch size."""
    return weighted_mean(stats.withColumnRenamed("mean", "v"), *keys)
