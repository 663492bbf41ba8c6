"""Mixing sources to target weights: Efraimidis-Spirakis order, running sums and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, running_total, uniform, whole_text

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = "mix"
# Sampling weight of a document by its quality label: good, poor, not labelled.
GOOD, POOR, UNKNOWN = 2.0, 0.5, 1.0


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Add ``weight``: the cycle dealt out in code point order of ``source``, null last.

    ``sources`` has a row per source.  They are put in order by ranges and numbered inside each range.
    """
    keys = [F.col("source").isNull().asc(), F.col("source").asc()]
    row = F.monotonically_increasing_id()
    placed = sources.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(
        placed.select(*sources.columns, F.shiftright(row, 33).alias("__part"), row.bitwiseAND((1 << 33) - 1).alias("__row")),
        "sources",
    )
    ranges = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # no more rows than shuffle partitions
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = ranges.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    turn = F.pmod(F.col("__before") + F.col("__row"), F.lit(len(cycle)))
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (turn + 1).cast("int"))
    return placed.join(before, "__part").withColumn("weight", weight).drop("__part", "__row", "__before")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Add ``target``: the share of all sizes dealt out by ``weight``, none above ``most`` times ``source_size``.

    What a full source leaves over goes to the others by weight until none is above its limit.  One level decides: a source
    gets the smaller of its limit and level times weight.  Each pass raises the level and fills more sources, until
    none is filled any more; a pass is one aggregation, and only its sums reach the driver.
    """
    limit = F.col("source_size") * F.lit(most)
    total, weights = sources.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share), F.coalesce(F.sum("weight"), F.lit(0.0))
    ).first()
    given, full = 0.0, 0
    while weights > 0:
        is_full = limit * F.lit(weights) <= F.col("weight") * F.lit(total - given)
        got = sources.agg(
            F.coalesce(F.sum(F.when(is_full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)),
            F.count_if(is_full),
        ).first()
        if got[2] == full:
            rest = F.col("weight") * F.lit(total - given) / F.lit(weights)
            return sources.withColumn("target", F.when(is_full, limit).otherwise(rest))
        given, weights, full = got
    return sources.withColumn("target", F.when(F.col("weight") > 0, limit).otherwise(F.lit(0.0)))


def row_key() -> Column:
    """Identity of a row for the mix: its id, source and text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source")]
    return F.md5(F.concat_ws("|", *parts, F.md5(whole_text().cast("binary"))).cast("binary"))


def mix(
    docs: DataFrame, sources: DataFrame | None = None, labels: DataFrame | None = None, seed: str = SEED
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, epochs, taken, row_key)`` for each row of ``docs``.

    ``docs`` has ``doc_id, text, source`` and, if wanted, ``sample_weight`` (positive; null or absent: 1);
    ``labels (doc_id, quality)`` give weights in its place.  A source whose target is t takes ``floor(t / source_size)`` whole epochs first.  The rest of the target is filled in the
    order of the keys ``-ln(u) / sample_weight``, smallest first, up to the exact word: the document at the border gives its
    first words only.  ``u`` hashes id, source and text, so reruns agree whatever the partitions; equal rows are
    interchangeable.  A null text has size 0 and is never taken; null is a source of its own.  ``sources`` may bring
    ``(source, weight)``, 0 for those not named; otherwise the cycle 3, 1, 2 is dealt out.  Other columns are ignored,
    an empty table gives an empty one.
    """
    weight = F.col("sample_weight").cast("double") if "sample_weight" in docs.columns else F.lit(None).cast("double")
    weight = F.when(weight > 0, weight).otherwise(F.lit(1.0))
    narrow = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        word_count(whole_text()).alias("size"),
        row_key().alias("row_key"),
        weight.alias("__w"),
        uniform(F.lit(seed), row_key()).alias("__u"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("__group"),
    )
    if labels is not None:  # the texts stay where they are, only these narrow rows are joined
        narrow = quality_weights(materialize(narrow, "mix"), labels)
    narrow = materialize(narrow.withColumn("__key", -F.log("__u") / F.col("__w")).drop("__u"), "mix")
    sums = narrow.groupBy("__group", "source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_rows"), F.avg("__w").alias("__mean")
    )
    if sources is None:
        sums = cycled_weights(sums)
    else:
        named = sources.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("__weight"))
        sums = sums.join(named, F.col("source").eqNullSafe(F.col("__source")), "left")
        sums = sums.withColumn("weight", F.coalesce("__weight", F.lit(0.0))).drop("__source", "__weight")
    goal = materialize(targets(materialize(sums, "mix-sources")), "mix-targets")
    rows = narrow.join(goal.select("__group", "source_size", "target", "__mean"), "__group")
    spread = F.least(F.lit(1.0) - F.exp(-F.col("__key") * F.col("__mean")), F.lit(1.0 - 2.0**-53))
    order = [F.col("__key"), F.col("row_key")]
    counts = goal.select("__group", "n_rows")
    rows = running_total(rows, "__group", spread, order, F.col("size"), "__earlier", counts)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size") - F.col("__earlier")
    part = F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return rows.withColumn("epochs", epochs.cast("bigint")).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "epochs",
        (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"),
        "row_key",
    )


def quality_weights(narrow: DataFrame, labels: DataFrame) -> DataFrame:
    """Weights by the quality label of the id in place of ``__w``; of several labels of an id the best counts."""
    best = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    best = best.select(F.col("doc_id").alias("__labelled"), "__quality")
    weight = F.when(F.col("__quality") >= 1, GOOD).when(F.col("__quality") < 1, POOR).otherwise(UNKNOWN)
    joined = narrow.join(best, F.col("doc_id") == F.col("__labelled"), "left")
    return joined.withColumn("__w", weight).drop("__labelled", "__quality")


def mixed_documents(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mixture as rows: a document once per whole repeat, and once more, cut after its last word, for a part.

    ``taken`` comes from ``mix`` over the same rows.  The columns of ``docs`` are kept; ``n_chars``, where it exists,
    follows a cut text.  Of equal rows the first get the larger numbers of repeats.  Documents without a word do not appear.
    """
    part = F.col("taken") - F.floor(F.col("taken") / F.col("size")) * F.col("size")
    plan = (
        taken.filter("taken > 0")
        .groupBy("row_key")
        .agg(
            F.max("size").alias("__size"),
            F.max("epochs").alias("__epochs"),
            F.count_if(F.col("taken") == (F.col("epochs") + 1) * F.col("size")).alias("__more"),
            F.max(part).alias("__part"),
        )
        .withColumnRenamed("row_key", "__plan_key")
    )
    keyed = docs.withColumn("__key", row_key())
    keyed = keyed.withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy(F.lit(0))))
    joined = keyed.join(plan, F.col("__key") == F.col("__plan_key"))
    copies = F.col("__epochs") + (F.col("__n") <= F.col("__more")).cast("bigint")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("__part").cast("int")), "")
    has_part = (F.col("__part") > 0) & (F.col("__n") == F.col("__more") + 1)
    texts = F.concat(
        F.array_repeat(F.col("text"), copies.cast("int")),
        F.when(has_part, F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    rows = joined.withColumn("__text", F.explode(texts))
    out = [F.col("__text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        same = F.col("__text") == F.col("text")
        length = F.char_length("__text").cast(docs.schema["n_chars"].dataType)
        out[at] = F.when(same, F.col("n_chars")).otherwise(length).alias("n_chars")
    return rows.select(*out)
