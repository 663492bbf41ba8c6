"""Language identification by interpolated Kneser-Ney character models kept in sorted key arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import uniform

ORDER = 4  # four 16-bit symbols fill a 64-bit key, so keys never collide
SAMPLE_DOCS = 600  # labelled documents per language that a model is fitted on, about
CALIBRATION_SHARE = 1 / 3  # of them, kept for the rejection limit
MOST_LANGUAGES = 256  # the most frequent labels are learned
ALPHABET = 4096  # symbols that the lowest order shares its rest among
REJECT_QUANTILE, REJECT_SLACK = 0.99, 2.0
SHARPNESS = 10.0
POSITIONS_AT_ONCE = 1 << 18
TEXTS_AT_ONCE = 512
UNKNOWN = "und"
SPACE, RARE = 32, 0xFFFF
PAD = np.full(ORDER - 1, SPACE, np.uint16)


@cache
def symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point (letters and marks their own, all else a space), and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    kept = letter | np.array([k == "M" for k in kinds])
    own = np.minimum(np.arange(0x110000), RARE).astype(np.uint16)
    return np.where(kept, own, np.uint16(SPACE)), letter


def symbols(text: str | None) -> np.ndarray | None:
    """Symbols of a whole text in lower case, runs of spaces as one; None for a text without a letter."""
    if not text:
        return None
    table, letter = symbol_table()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not letter[points].any():
        return None
    own = np.append(table[points], np.uint16(SPACE))
    space = own == SPACE
    return own[~(space & np.append(True, space[:-1]))]


def keys_of(padded: np.ndarray) -> np.ndarray:
    """The key of the ORDER symbols that end at each place from ORDER - 1 on."""
    wide = padded.astype(np.uint64)
    out = np.zeros(len(wide) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(16) | wide[k : len(wide) - ORDER + 1 + k]
    return out


def place(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def suffix(keys: np.ndarray, symbols_kept: int) -> np.ndarray:
    return keys & np.uint64((1 << (16 * symbols_kept)) - 1)


@dataclass
class Level:
    """Grams of one order in any language: log probabilities, and the log weights left to the order below per context."""

    keys: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_rest: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]  # from order 1 on
    log_unseen: np.ndarray
    limits: np.ndarray | None = None

    def log_probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last symbol of each key, a column per language."""
        if order == 0:
            return np.broadcast_to(self.log_unseen, (len(keys), len(self.languages)))
        level = self.levels[order - 1]
        at, there = place(level.keys, keys)
        out = level.log_p[at]
        if not there.all():
            lost = keys[~there]
            ctx, known = place(level.contexts, lost >> np.uint64(16))
            rest = np.where(known[:, None], level.log_rest[ctx], np.float32(0)) if order > 1 else np.float32(0)
            out[~there] = rest + self.log_probability(suffix(lost, order - 1), order - 1)
        return out

    def cross_entropy(self, texts: list[np.ndarray]) -> np.ndarray:
        """Nats per symbol of each text under each language; texts are symbol arrays that are not empty."""
        total = np.zeros((len(texts), len(self.languages)))
        for owners, padded in blocks(texts):
            lengths = np.array([len(x) - ORDER + 1 for x in padded])
            found = self.log_probability(np.concatenate([keys_of(x) for x in padded])).astype(np.float64)
            np.add.at(total, owners, np.add.reduceat(found, np.cumsum(lengths) - lengths))
        return -total / np.array([len(t) for t in texts])[:, None]


def blocks(texts: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Padded texts with their numbers, about POSITIONS_AT_ONCE symbols at a time; a longer text comes in overlapping pieces."""
    owners, padded, size = [], [], 0
    for k, text in enumerate(texts):
        whole = np.concatenate([PAD, text])
        for first in range(0, len(text), POSITIONS_AT_ONCE):
            piece = whole[first : first + POSITIONS_AT_ONCE + ORDER - 1]
            if owners and size + len(piece) > POSITIONS_AT_ONCE:
                yield owners, padded
                owners, padded, size = [], [], 0
            owners.append(k)
            padded.append(piece)
            size += len(piece)
    if owners:
        yield owners, padded


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from ``(sorted keys, counts)`` of the highest order per language.

    The highest order counts occurrences, the others the different symbols that stand before a gram.  Each order gives up a
    discount for the order below it (estimated from its counts of one and two), the lowest for the alphabet.
    """
    languages = sorted(counts)
    own: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    for name in languages:
        orders = {ORDER: counts[name]}
        for n in range(ORDER - 1, 0, -1):
            orders[n] = np.unique(suffix(orders[n + 1][0], n), return_counts=True)
        own.append(orders)
    levels, below, log_unseen = [], None, None
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([orders[n][0] for orders in own]))
        contexts = np.unique(keys >> np.uint64(16))
        p = np.zeros((len(keys), len(own)))
        rest = np.ones((len(contexts), len(own)))
        for k, orders in enumerate(own):
            grams, seen = orders[n]
            ones, twos = (seen == 1).sum(), (seen == 2).sum()
            discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))
            of_context = np.searchsorted(contexts, grams >> np.uint64(16))
            sums = np.bincount(of_context, seen, len(contexts))
            kinds = np.bincount(of_context, minlength=len(contexts))
            rest[:, k] = np.where(sums > 0, discount * kinds / np.maximum(sums, 1), 1.0)
            at, there = place(grams, keys)
            ctx = np.searchsorted(contexts, keys >> np.uint64(16))
            taken = np.where(there, np.maximum(seen[at] - discount, 0), 0) / np.maximum(sums[ctx], 1)
            if n == 1:
                lower = 1 / ALPHABET
            else:
                lower = below[1][np.searchsorted(below[0], suffix(keys, n - 1)), k]
            p[:, k] = taken + rest[ctx, k] * lower
        if n == 1:
            log_unseen = np.log(rest[0] / ALPHABET).astype(np.float32)
        levels.append(Level(keys, np.log(p).astype(np.float32), contexts, np.log(rest).astype(np.float32)))
        below = (keys, p)
    return Model(languages, levels, log_unseen)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_language: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = symbols(text)
            if own is not None:
                by_language.setdefault(lang, []).append(keys_of(np.concatenate([PAD, own])))
        for lang, keys in by_language.items():
            grams, n = np.unique(np.concatenate(keys), return_counts=True)
            columns = [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, languages: int = MOST_LANGUAGES) -> Model:
    """Fit and calibrate on about ``sample_docs`` documents per language of ``(doc_id, text, lang)``.

    The sample is drawn by a hash of id and text, so it does not depend on partitions.  Grams are counted in Spark; the
    driver gets the counts of the sample, bounded by its size.  A third of the sample sets each language's limit:
    twice the 99th percentile of the cross-entropy of its own documents.
    """
    labelled = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    sizes = sizes.orderBy(F.col("size").desc(), "lang").limit(languages)
    draw = uniform(F.lit("langid"), F.col("doc_id"), F.md5(F.col("text").cast("binary")))
    share = F.col("draw") * F.greatest(F.col("size") / F.lit(float(sample_docs)), F.lit(1.0))
    sample = labelled.withColumn("draw", draw).join(F.broadcast(sizes), "lang").withColumn("share", share)
    sample = sample.filter("share < 1").select("lang", "text", "share")
    for_fit = sample.filter(F.col("share") >= CALIBRATION_SHARE).select("lang", "text")
    counted = for_fit.mapInArrow(_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names, grams = table["lang"].to_numpy(), table["gram"].to_numpy().view(np.uint64)
    n = table["n"].to_numpy()
    counts = {}
    for name in set(names.tolist()):
        mine = names == name
        order = np.argsort(grams[mine])
        counts[name] = grams[mine][order], n[mine][order]
    if not counts:
        return Model([], [], np.zeros(0, np.float32), np.zeros(0))
    model = fit(counts)
    known = sample.filter(F.col("share") < CALIBRATION_SHARE).select("lang", "text")
    measured = _scored(known, model, "lang", known.schema["lang"].dataType.simpleString()).toArrow()
    measured = measured.to_pandas()
    same = measured[measured.lang == measured.lang_pred]
    overall = same.cross_entropy.quantile(REJECT_QUANTILE) if len(same) else np.inf
    by = same.groupby("lang").cross_entropy.quantile(REJECT_QUANTILE)
    model.limits = np.array([by.get(x, overall) for x in model.languages]) * REJECT_SLACK
    return model


def _entropies(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts that can be judged and their cross-entropies, a column per language; few texts are held unpacked."""
    places, found = [np.zeros(0, np.int64)], [np.zeros((0, len(model.languages)))]
    if model.languages:
        for first in range(0, len(column), TEXTS_AT_ONCE):
            texts = [symbols(x.as_py()) for x in column.slice(first, TEXTS_AT_ONCE)]
            there = [k for k, x in enumerate(texts) if x is not None]
            if there:
                places.append(first + np.array(there))
                found.append(model.cross_entropy([texts[k] for k in there]))
    return np.concatenate(places), np.concatenate(found)


def _scored(df: DataFrame, model: Model, key: str, kind: str) -> DataFrame:
    """``key, lang_pred, score, cross_entropy, rejected`` from ``(key, text)``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            there, found = _entropies(batch.column(1), model)
            names = np.full(batch.num_rows, UNKNOWN, object)
            score, entropy = np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
            rejected = np.ones(batch.num_rows, bool)
            if len(there):
                best = found.argmin(1)
                least = found[np.arange(len(best)), best]
                names[there] = np.array(model.languages, object)[best]
                score[there] = 1 / np.exp(SHARPNESS * (least[:, None] - found)).sum(1)
                entropy[there] = least
                rejected[there] = least > model.limits[best] if model.limits is not None else False
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(score)]
            columns += [pa.array(entropy, from_pandas=True), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, [key, "lang_pred", "score", "cross_entropy", "rejected"])

    schema = f"{key} {kind}, lang_pred string, score double, cross_entropy double, rejected boolean"
    return df.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score, cross_entropy, rejected)`` of each row, from its whole text only.

    The language with the lowest cross-entropy per symbol is predicted, of equal ones the first by name.  ``score`` is its
    share among all languages.  A null text or one without a letter is ``und`` with score 0 and rejected, and so is every row if
    no language was learned; a text is also rejected if its cross-entropy exceeds the language's limit.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col("text").cast("string").alias("text"))
    return _scored(rows, model, id_col, rows.schema[id_col].dataType.simpleString())


def fold(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            there, found = _entropies(batch.column(at), model)
            keep = np.zeros(batch.num_rows, bool)
            if len(there):
                best = found.argmin(1)
                keep[there] = found.min(1) <= model.limits[best]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
