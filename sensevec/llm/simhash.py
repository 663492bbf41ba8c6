"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, whole_text

BITS = 64
LANE = 22  # bits of a vote counter; three of them share a 64-bit sum
LANES = 3
CHUNK = 1 << 18  # terms that are added up before the counters are unpacked, so that none overflows
SEPARATOR = r"[^\p{L}\p{N}]+"
RADIUS = 3
BLOCKS = 6
MOST_RANGES = 2048


def terms(text: Column) -> Column:
    """Words of a text in lower case; the empty text has one empty word."""
    return F.split(F.lower(text), SEPARATOR)


def term_hashes(words: Column) -> Column:
    """Hash of each word with the word after it, the last word alone."""
    after = F.slice(words, F.lit(2), F.size(words))
    return F.zip_with(words, after, lambda a, b: F.xxhash64(a, b))


def votes(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """``keys`` and ``fingerprint`` (bigint) from an array of words per row; the keys must tell rows apart.

    Every term votes with its number of occurrences on each bit of its hash: for the bit if it is set, against it if
    not; a tie leaves it unset.  Counters of three bits are added up in one 64-bit sum, so 22 sums hold all votes.
    """
    lanes = sum(1 << (LANE * k) for k in range(LANES) if LANE * k < BITS)
    exploded = rows.select(*keys, F.posexplode(term_hashes(F.col(words))).alias("__at", "__hash"))
    packed = exploded.groupBy(*keys, F.floor(F.col("__at") / CHUNK).alias("__chunk")).agg(
        F.count("*").alias("__n"),
        *[F.sum(F.shiftrightunsigned("__hash", i).bitwiseAND(F.lit(lanes))).alias(f"__s{i}") for i in range(LANE)],
    )

    def counter(bit: int) -> Column:
        lane, i = divmod(bit, LANE)
        return F.shiftrightunsigned(f"__s{i}", LANE * lane).bitwiseAND(F.lit((1 << LANE) - 1))

    total = packed.groupBy(*keys).agg(
        F.sum("__n").alias("__n"), *[F.sum(counter(b)).alias(f"__b{b}") for b in range(BITS)]
    )
    value = F.lit(0).cast("bigint")
    for b in range(BITS):
        mask = 1 << b if b < BITS - 1 else -(1 << b)
        value = value.bitwiseOR(F.when(F.col(f"__b{b}") * 2 > F.col("__n"), F.lit(mask)).otherwise(F.lit(0)))
    return total.select(*keys, value.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` rows as ``(doc_id, fingerprint)`` with a bigint fingerprint of the whole text, null taken as empty.

    Equal texts get equal fingerprints; rows that repeat id and text come out once.
    """
    rows = docs.select("doc_id", F.md5(whole_text().cast("binary")).alias("__text"), terms(whole_text()).alias("__words"))
    return votes(rows, ["doc_id", "__text"], "__words").drop("__text")


def with_next(docs: DataFrame) -> DataFrame:
    """``(part, place, guest, doc_id, text, next_text)``: rows with the text of the next row by descending id.

    Null ids come last, equal ids are ordered by text; after the last row comes the first.  Ids are cut into ranges at
    approximate quantiles, at most 2,048 of them, and the texts are shuffled once, by range.  So that a range knows what follows it, the first
    row of the range below is added to it as a guest.
    """
    docs = docs.select("doc_id", whole_text().alias("text"))
    ranges = min(4 * shuffle_partitions(docs.sparkSession), MOST_RANGES)
    ids = docs.select(F.col("doc_id").cast("double").alias("id")).filter("id is not null")
    cuts = ids.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.25 / ranges)
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    ranged = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    ranged = Bucketizer(splits=splits, inputCol="__id", outputCol="__range").transform(ranged)
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("__range").cast("int"))
    ranged = ranged.select("doc_id", "text", part.alias("part"))
    # one row per range, so these windows and the broadcast are small at any size
    tops = ranged.groupBy("part").agg(F.struct(F.max("doc_id").alias("top")).alias("first"))
    below = W.orderBy(F.col("part").desc())
    wrapped = F.first("first").over(below.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = tops.select(F.col("part").alias("owner"), F.coalesce(F.lead("first").over(below), wrapped).alias("first"))
    first = first.select("owner", F.col("first.top").alias("top"))
    same = F.col("doc_id").eqNullSafe(F.col("top"))
    guests = ranged.drop("part").join(F.broadcast(first), same).groupBy("owner", "doc_id").agg(F.min("text").alias("text"))
    both = ranged.withColumn("guest", F.lit(False)).unionByName(
        guests.select("doc_id", "text", F.col("owner").alias("part"), F.lit(True).alias("guest"))
    )
    order = W.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return both.select(
        "part", F.row_number().over(order).alias("place"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text")
    )


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many first ones of the following text, or all it has."""
    size = F.char_length(text)
    cut = F.floor(size / 3).cast("int")
    return F.concat(F.left(text, size - cut), F.left(following, cut))


def compare_edited(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, own, own_edited, near_edited, near_next)`` for each row, fingerprints as bigint.

    A single row is its own next one; an empty table gives an empty one; other columns are ignored.
    """
    rows = with_next(docs)
    changed = edited(F.col("text"), F.coalesce("next_text", F.lit("")))
    rows = rows.select("part", "place", "guest", "doc_id", "text", changed.alias("changed"))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("kind"), F.col("changed").alias("body")),
    )
    rows = rows.select(
        "part",
        "place",
        "guest",
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.unhex(F.sha2(F.col("changed").cast("binary"), 256)).alias("digest"),
        F.inline(kinds),
    )
    keys = ["part", "place", "guest", "doc_id", "n_chars", "digest"]
    voted = votes(rows.select(*keys, "kind", terms(F.col("body")).alias("words")), [*keys, "kind"], "words")
    pairs = voted.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("own"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("own_edited"),
    )
    following = F.lead("own").over(W.partitionBy("part").orderBy("place"))
    return (
        pairs.withColumn("__next", following)
        .filter(~F.col("guest"))
        .select(
            "doc_id",
            "n_chars",
            F.lower(F.hex("digest")).alias("edited_sha256"),
            "own",
            "own_edited",
            likeness(F.col("own"), F.col("own_edited")).alias("near_edited"),
            likeness(F.col("own"), F.col("__next")).alias("near_next"),
        )
    )


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask per table: all ways to keep ``blocks - radius`` blocks, as signed 64-bit integers.

    Differences in ``radius`` bits touch as many blocks at most, so two fingerprints that near agree in a kept choice.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("a radius must be below the number of blocks")
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    masks = [sum(choice) for choice in combinations(parts, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def within_radius(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs ``(query, found)`` of distinct fingerprints whose Hamming distance is at most ``radius``.

    ``queries`` and ``stored`` have one bigint column ``fingerprint``; null ones find nothing.  Both sides are keyed by the
    kept blocks of every table and meet in one join.  A pair is reported by the first table in which it agrees.
    """
    masks = block_masks(radius, blocks)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        values = df.select(F.col("fingerprint").alias(name)).filter(F.col(name).isNotNull()).distinct()
        tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
        return values.select(name, F.inline(tables))

    pairs = keyed(queries, "query").join(keyed(stored, "found"), ["table", "key"])
    other = F.col("query").bitwiseXOR(F.col("found"))
    first = F.lit(len(masks))
    for k, m in reversed(list(enumerate(masks))):
        first = F.when(other.bitwiseAND(F.lit(m)) == 0, F.lit(k)).otherwise(first)
    near = F.bit_count(other) <= radius
    return pairs.filter(near & (first == F.col("table"))).select("query", "found")


def found_within(made: DataFrame, asks: Column, radius: int = RADIUS) -> DataFrame:
    """``(query, n_within, rows_within, first_within)`` for the fingerprints ``own`` of the rows where ``asks`` holds.

    The search returns pairs of distinct fingerprints; each stands for its rows, copies included: ``n_within`` counts the other
    fingerprints within the radius, ``rows_within`` all rows behind them and behind the asked one, ``first_within`` is their smallest id.
    """
    stored = materialize(
        made.groupBy(F.col("own").alias("fingerprint")).agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")), "stored"
    )
    queries = made.filter(asks).select(F.col("own").alias("fingerprint"))
    pairs = within_radius(queries, stored.select("fingerprint"), radius)
    return pairs.join(stored, F.col("found") == F.col("fingerprint")).groupBy("query").agg(
        (F.count("*") - 1).alias("n_within"), F.sum("rows").alias("rows_within"), F.min("first").alias("first_within")
    )


def report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of ``compare_edited`` as text, and for ids divisible by 100 what the search finds among all rows.

    ``n_within`` counts other distinct fingerprints within the radius, ``rows_within`` the other rows with these or with the same
    fingerprint, ``first_within`` is the smallest id of all those rows and the row itself; all three are null for the other rows.
    """
    made = materialize(compare_edited(docs), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    found = found_within(made, asks, radius)
    asked = made.filter(asks).join(found, F.col("own") == F.col("query"), "left").drop("query")
    asked = asked.withColumn("rows_within", F.col("rows_within") - 1)
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("n_within", "rows_within", "first_within")]
    rows = asked.unionByName(made.filter(~asks).select("*", *none))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("own_edited")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_within",
        "rows_within",
        "first_within",
    )
