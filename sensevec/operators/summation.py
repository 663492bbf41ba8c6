"""Exact sums and means per key: doubles are added up as long integers, so neither order nor number of rows leaves an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 20  # bits of a limb: 2 ** 43 values can be added before a 64-bit sum could overflow
LIMBS = 114  # hold the largest double times 2 ** 43
POINT = 1134  # the lowest limb counts units of 2 ** -POINT, below the smallest double
MASK = (1 << LIMB) - 1
FRACTION = 54  # bits behind the point that a value scaled to [1, 2) is read with


def _limbs(value: str) -> str:
    """SQL: the non-zero limbs of a finite double as ``(limb, part)``.

    The value is scaled by a power of two to about [1, 2), which is exact, and read as an integer of at most 57 bits; its bits are
    cut where the limbs of the common grid begin.  The exponent may be one off near a power of two without harm.
    """
    exponent = f"cast(floor(log2(abs({value}))) as int)"
    half = f"(-{exponent} div 2)"
    whole = f"cast(abs({value}) * pow(2D, {half}) * pow(2D, -{exponent} - {half}) * pow(2D, {FRACTION}) as bigint)"
    place = f"({exponent} + {POINT - FRACTION})"
    low = f"({LIMB} - {place} % {LIMB})"
    rest = f"shiftright({whole}, {low})"
    parts = [
        f"shiftleft({whole} & (shiftleft(1L, {low}) - 1), {place} % {LIMB})",
        f"{rest} & {MASK}",
        f"shiftright({rest}, {LIMB}) & {MASK}",
        f"shiftright({rest}, {2 * LIMB})",
    ]
    sign = f"cast(sign({value}) as bigint)"
    cells = [f"named_struct('limb', {place} div {LIMB} + {k}, 'part', {sign} * ({part}))" for k, part in enumerate(parts)]
    return f"filter(array({', '.join(cells)}), c -> c.part <> 0)"


def _digits(limbs: Column) -> Column:
    """Limbs with carries resolved: every digit in ``[0, 2 ** 20)``, and the sign in the last carry."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def step(done: Column, limb: Column) -> Column:
        total = done["carry"] + limb
        digit = total.bitwiseAND(F.lit(MASK).cast("bigint"))
        return F.struct(F.shiftright(total, LIMB).alias("carry"), F.concat(done["digits"], F.array(digit)).alias("digits"))

    return F.aggregate(limbs, start, step)


def _rounded(sums: DataFrame) -> DataFrame:
    """``total`` from ``limbs``: the leading 55 bits and whether any bit is set below, rounded once to a double."""
    rows = sums.withColumn("negative", _digits(F.col("limbs"))["carry"] < 0)
    signed = F.transform("limbs", lambda x: F.when(F.col("negative"), -x).otherwise(x))
    rows = rows.withColumn("d", _digits(signed)["digits"])
    rows = rows.withColumn("top", F.expr("array_max(filter(sequence(0, size(d) - 1), i -> d[i] <> 0))"))
    digit = "coalesce(get(d, top - {}), 0L)".format
    rows = rows.withColumn("b", F.expr("length(bin(d[top]))")).withColumn(
        "high", F.expr(f"shiftleft(d[top], {2 * LIMB}) | shiftleft({digit(1)}, {LIMB}) | {digit(2)}")
    )
    rows = rows.withColumn("next", F.expr(digit(3)))
    below = "exists(slice(d, 1, greatest(top - 3, 0)), x -> x <> 0)"
    # 40 + b bits are in ``high``: some go, or some of the next limb come in
    wide = "named_struct('m', shiftright(high, b - 15), 'rest', (high & (shiftleft(1L, b - 15) - 1)) <> 0 or next <> 0)"
    narrow = "named_struct('m', shiftleft(high, 15 - b) | shiftright(next, 5 + b), 'rest', (next & (shiftleft(1L, 5 + b) - 1)) <> 0)"
    rows = rows.withColumn("lead", F.expr(f"if(b >= 15, {wide}, {narrow})"))
    # the last bit stands for all that is below, so the conversion rounds as the exact value would
    rows = rows.withColumn("m", F.expr(f"lead.m * 2 + if(lead.rest or {below}, 1, 0)"))
    rows = rows.withColumn("e", F.expr(f"{LIMB} * (top - 2) - {POINT} + b - 16"))
    size = F.expr("cast(m as double) * pow(2D, e div 2) * pow(2D, e - e div 2)")
    return rows.withColumn("total", F.when(F.col("top").isNull(), F.lit(0.0)).when(F.col("negative"), -size).otherwise(size))


def compensated_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, total, n)``: exact sums, rounded once; ``n`` counts values that are not null.

    Every value becomes up to four limbs of a fixed grid, and limbs are summed as 64-bit integers by key and place, in the map tasks first.  A
    key leaves a task in at most as many rows as the grid has limbs.  NaN and infinities come out as in plain addition, and so does a sum
    beyond the largest double; a key without values has total 0.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    real = "value is not null and not isnan(value) and abs(value) < double('infinity')"
    marks = (
        "named_struct('limb', -1, 'part', 0L, 'n', if(value is null, 0L, 1L), 'nan', if(isnan(value), 1L, 0L), "
        "'up', if(value = double('infinity'), 1L, 0L), 'down', if(value = -double('infinity'), 1L, 0L))"
    )
    none = "'n', 0L, 'nan', 0L, 'up', 0L, 'down', 0L"
    limbs = f"if({real} and value <> 0, {_limbs('value')}, cast(array() as array<struct<limb: int, part: bigint>>))"
    cells = f"concat(array({marks}), transform({limbs}, c -> named_struct('limb', cast(c.limb as int), 'part', c.part, {none})))"
    placed = rows.select("key", F.expr(f"inline({cells})"))
    by_limb = placed.groupBy("key", "limb").agg(*[F.sum(c).alias(c) for c in ("part", "n", "nan", "up", "down")])
    # at most one row per limb
    entries = F.map_from_entries(F.collect_list(F.when(F.col("limb") >= 0, F.struct("limb", "part"))))
    per_key = by_limb.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "nan", "up", "down")], entries.alias("cells"))
    every = F.transform(F.sequence(F.lit(0), F.lit(LIMBS - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0).cast("bigint")))
    total = _rounded(per_key.withColumn("limbs", every))
    undefined = (F.col("nan") > 0) | ((F.col("up") > 0) & (F.col("down") > 0))
    value = (
        F.when(undefined, F.lit(float("nan")))
        .when(F.col("up") > 0, F.lit(float("inf")))
        .when(F.col("down") > 0, F.lit(float("-inf")))
        .otherwise(F.col("total"))
    )
    return total.select(F.col("key").alias(key), value.alias("total"), "n")


def stable_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, mean, n)``."""
    return compensated_sum(df, key, value).select(
        key, F.try_divide(F.col("total"), F.col("n")).alias("mean"), "n"
    )
