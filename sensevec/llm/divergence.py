"""How far the sources of a language differ in their words: exact sums over cubes of (source block, source block, term block)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BETWEEN = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # what stands between terms; only A to Z are lower-cased
BYTES_AT_ONCE = 1 << 22
FEWEST_DOCS = 30  # of a language with a term that counts
TOP_TERMS = 50
GROUP_BLOCK = 64  # sources of one side of a cell
TERM_BLOCK = 4096  # terms of a cell, about
UNIT, ADDED = 1_000_000_000, 5


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 kept))`` in whole numbers that cannot overflow; ``kept`` is not 0."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(ADDED).cast("decimal(1,0)"))
    below = total.cast("decimal(20,0)") + (kept.cast("decimal(18,0)") * F.lit(ADDED).cast("decimal(1,0)"))
    return F.call_function("div", top, below) + F.lit(1)


def _counts_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), BETWEEN)
    offsets, named = lists.offsets.to_numpy(), pc.dictionary_encode(lists.flatten())
    codes, width = named.indices.to_numpy(), len(named.dictionary) + 1
    doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    empty = pc.index(named.dictionary, "").as_py()
    real = codes != empty
    of_doc, times = np.unique(doc[real] * np.int64(width) + codes[real], return_counts=True)
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy() * np.int64(len(sources.dictionary)) + sources.indices.to_numpy()
    key, place = np.unique(group[of_doc // width] * width + of_doc % width, return_inverse=True)
    n, docs = np.bincount(place, times, len(key)).astype(np.int64), np.bincount(place, minlength=len(key))
    at = key // width
    columns = [
        langs.dictionary.take(pa.array(at // len(sources.dictionary))),
        sources.dictionary.take(pa.array(at % len(sources.dictionary))),
        named.dictionary.take(pa.array(key % width)),
        pa.array(n),
        pa.array(docs, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) // BYTES_AT_ONCE
        cuts = np.append(np.append(0, np.flatnonzero(np.diff(block)) + 1), batch.num_rows)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield _counts_of(batch.slice(a, b - a))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and rows that have the term.

    ``docs`` is ``(text, lang, source)`` without nulls.  Tasks count what a few megabytes of text hold, Spark adds these counts up.
    """
    counted = docs.select("text", "lang", "source").mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _cell(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of ``|p - q|`` over the cell's terms for each pair of a left and a right source; an absent term has the source's ``absent``."""
    lang, low, high = key[0], key[1], key[2]
    kept = int(frame.block_terms.iloc[0])
    real = frame.term.notna().to_numpy()
    column = np.full(len(frame), -1)
    column[real] = pd.factorize(frame.term[real])[0]
    width = int(column.max()) + 1
    sides = []
    for block in (low, high):
        mine = (frame.group_block == block).to_numpy()
        at, names = pd.factorize(frame.source.to_numpy(object)[mine])
        absent = np.zeros(len(names), np.int64)
        absent[at] = frame.absent[mine].to_numpy()
        table = np.repeat(absent[:, None], width, axis=1)
        there = real[mine]
        table[at[there], column[mine][there]] = frame.p[mine].to_numpy()[there].astype(np.int64)
        sides.append((names, absent, table))
    (left, absent_a, a), (right, absent_b, b) = sides
    if not len(left) or not len(right):  # a hash left one of the blocks empty
        return pd.DataFrame({"lang": [], "source": [], "item": [], "value": []}, dtype=object)
    found = [np.abs(a[k] - b).sum(1) + (kept - width) * np.abs(absent_a[k] - absent_b) for k in range(len(left))]
    source, item, value = np.repeat(left, len(right)), np.tile(right, len(left)), np.concatenate(found)
    once = source < item if low == high else np.ones(len(source), bool)
    return pd.DataFrame({"lang": [lang] * int(once.sum()), "source": source[once], "item": item[once], "value": value[once]}, dtype=object)


def audit(
    docs: DataFrame,
    fewest_docs: int = FEWEST_DOCS,
    top_terms: int = TOP_TERMS,
    group_block: int = GROUP_BLOCK,
    term_block: int = TERM_BLOCK,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` over whole texts of ``(text, lang, source)``; nulls count as the empty string.

    A language keeps the terms that at least ``fewest_docs`` of its rows have, and each (language, source) that occurs, like each language
    as a whole, gives every kept term a share of 10^9.  Part ``pair`` has for each source the sums of absolute differences to every other
    source of its language, part ``term`` the ``top_terms`` terms whose share in the source is furthest above that in the language.
    Values rank from the highest, equal ones by item in UTF-8 order.  Rows that repeat count each.

    Term counts are written once.  Cells own (source block, source block, term block): a source's counts go to the cells of its
    block with every other block, a cell holds at most two blocks of sources by about ``term_block`` terms, and partial sums are added up over
    the term blocks.  Kept terms that a source lacks are not sent: they all have one share, which the cell adds by number.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    docs = docs.select(*text)
    counts = materialize(term_counts(docs), "term-counts")
    per_lang = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    kept = materialize(per_lang.filter(F.col("docs") >= fewest_docs).select("lang", "term", F.col("n").alias("lang_n")), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    mine = materialize(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    totals = mine.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("bigint")
    filled = [F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")]
    sizes = docs.select("lang", "source").distinct().groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.select("lang", "source", *filled).join(sizes, "lang")
    some = F.col("kept") > 0
    blocks = F.ceil(F.col("sources") / F.lit(group_block)).cast("int")
    groups = groups.select(
        "lang",
        "source",
        "total",
        "kept",
        "lang_total",
        blocks.alias("blocks"),
        F.pmod(F.xxhash64("source"), blocks).cast("int").alias("group_block"),
        F.greatest(F.lit(1), F.ceil(F.col("kept") / F.lit(term_block))).cast("int").alias("term_blocks"),
        F.when(some, share(zero, F.col("total"), F.col("kept"))).otherwise(zero).alias("absent"),
    )
    groups = materialize(groups, "groups")
    p = mine.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    p = materialize(p.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))), "shares")
    return _pairs(p, groups, kept).unionByName(_terms(p, top_terms))


def _pairs(p: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    block = F.pmod(F.xxhash64(F.lit(1), "term"), F.col("term_blocks")).cast("int").alias("term_block")
    lang_blocks = groups.select("lang", "term_blocks", "blocks").distinct()
    sizes = kept.join(lang_blocks, "lang").groupBy("lang", block).agg(F.count("*").alias("block_terms"))
    every = lang_blocks.select("lang", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"))
    sizes = every.join(sizes, ["lang", "term_block"], "left").select("lang", "term_block", F.coalesce("block_terms", F.lit(0)).alias("block_terms"))
    slices = p.select("lang", "source", "blocks", "group_block", block, "term", "p", "absent")
    # one row without a term brings each source into all its cells
    bare = groups.select(
        "lang",
        "source",
        "blocks",
        "group_block",
        F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"),
        F.lit(None).cast("string").alias("term"),
        F.lit(0).cast("bigint").alias("p"),
        "absent",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = slices.unionByName(bare).select("*", other).select(
        "lang",
        F.least("group_block", "other").alias("low"),
        F.greatest("group_block", "other").alias("high"),
        "term_block",
        "group_block",
        "source",
        "term",
        "p",
        "absent",
    )
    cells = cells.join(sizes, ["lang", "term_block"])
    partial = cells.groupBy("lang", "low", "high", "term_block").applyInPandas(_cell, "lang string, source string, item string, value bigint")
    once = materialize(partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    both = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return _ranked(both.withColumn("part", F.lit("pair")))


def _terms(p: DataFrame, top_terms: int) -> DataFrame:
    above = p.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(above).filter(F.col("rank") <= top_terms)


def _ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


def oracle(fewest_docs: int = FEWEST_DOCS, top_terms: int = TOP_TERMS) -> str:
    """The same rows in DuckDB's SQL, straight from the definition."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents),
w AS (SELECT r, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {fewest_docs}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {top_terms}"""
