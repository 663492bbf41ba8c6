"""Near-duplicate texts by Order MinHash: minimum k-mers in text order find candidates, banded alignment verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .alignment import similar
from .common import components, discard, materialize, possible_keys, whole_text

WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5  # words of a k-mer
SAMPLES = 10  # sketches of a text
KMERS = 3  # minimum k-mers of a sketch
# Texts of so many words, from and to, also have so many sketches of so many minimum k-mers of so many words, for scattered
# edits; the ranges overlap by more than the lengths of linked texts can differ.
FURTHER = ((1, 15, 20, 2, 1), (12, 60, 30, 2, 2), (45, 1 << 62, 50, 3, 2))
SIMILARITY = 0.8
PAIRED = 32  # members of a bucket up to which each is compared with each of other classes
BLOCK_ROWS = 256  # larger buckets are compared block by block
BLOCK_WORDS = 1 << 20  # that the texts of a block have together, about
BINS = 128  # of the word counts that rule pairs out
FINE_BINS = 1024  # where the words are at hand
MOST_OF_BIN = 255  # counts are cut off there, which can only leave more pairs open
ROWS_AT_ONCE = 64
COUNTS_AT_ONCE = 1 << 21
HASHES_AT_ONCE = 1 << 17
WORDS_AT_ONCE = 100_000
PAIRS_AT_ONCE = 512

# Odd multipliers of a published 64-bit mixer.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LAST = np.uint64((1 << 64) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def labelled_kmers(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each k-mer and of how many equal ones stand before it; a shorter text is one k-mer."""
    return _labelled(words, np.array([0, len(words)]), max(1, min(size, len(words))))[0]


def _labelled(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of texts that lie side by side, and where those of each text begin; texts shorter than a k-mer have none."""
    n = max(0, len(words) - size + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams = mixed(grams) + words[k : k + n]
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    starts = np.append(0, np.cumsum(counts))
    text = np.repeat(np.arange(len(counts)), counts)
    grams = grams[np.arange(starts[-1]) - starts[text] + offsets[text]]
    # equal k-mers of one text in a row, in the order of the text
    order = np.argsort(mixed(grams ^ text.astype(np.uint64) * MIX_B), kind="stable")
    ordered, of = grams[order], text[order]
    same = (ordered[1:] == ordered[:-1]) & (of[1:] == of[:-1])
    at = np.arange(len(order))
    run = at - np.maximum.accumulate(np.where(np.append(False, same)[: len(order)], 0, at))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = run
    return mixed(grams + occurrence * MIX_A), starts


@cache
def _seeds(samples: int) -> np.ndarray:
    return mixed(np.arange(1, samples + 1, dtype=np.uint64) * MIX_B) | np.uint64(1)


@cache
def _names(samples: int, kmers: int, size: int) -> np.ndarray:
    return mixed(np.arange(samples, dtype=np.uint64) + np.uint64(1000 * (10 * kmers + size)))


def _minima(grams: np.ndarray, samples: int, kmers: int) -> np.ndarray:
    """For each sample the k-mers with the smallest hashes, joined in the order of the text."""
    kmers, seeds = min(kmers, len(grams)), _seeds(samples)
    out = np.empty(samples, np.uint64)
    at_once = max(1, HASHES_AT_ONCE // len(grams))
    for first in range(0, samples, at_once):
        part = seeds[first : first + at_once]
        values = grams[None, :] * part[:, None]  # k-mer hashes are mixed already: a seed's product orders them anew
        least, rows = np.empty((len(part), kmers), np.int64), np.arange(len(part))
        for k in range(kmers):
            least[:, k] = values.argmin(axis=1)
            values[rows, least[:, k]] = LAST
        least.sort(axis=1)
        joined = np.zeros(len(part), np.uint64)
        for k in range(kmers):
            joined = mixed(joined + grams[least[:, k]])
        out[first : first + at_once] = joined
    return out


def sketches(words: np.ndarray, samples: int = SAMPLES, kmers: int = KMERS, size: int = SHINGLE) -> np.ndarray:
    """Order MinHash of one text."""
    return _minima(labelled_kmers(words, size), samples, kmers)


def _kinds(size: int) -> list[tuple[int, int, int]]:
    """``(samples, minimum k-mers, words of a k-mer)`` of the sketches of a text of so many words."""
    return [(SAMPLES, KMERS, SHINGLE), *(tuple(kind) for low, high, *kind in FURTHER if low <= size <= high)]


def all_sketches(words: np.ndarray) -> np.ndarray:
    """Sketches of long k-mers, and those for scattered edits; each names its kind and sample."""
    return np.concatenate([mixed(sketches(words, *kind) + _names(*kind)) for kind in _kinds(len(words))])


def _sketches_of(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """``all_sketches`` of texts side by side; k-mers are hashed for all of them at once."""
    sizes, made, out = np.diff(offsets), {}, []
    for k, size in enumerate(sizes.tolist()):
        if not size:
            out.append(np.zeros(0, np.int64))
            continue
        parts = []
        for kind in _kinds(size):
            words = kind[2]
            if size < words:
                grams = labelled_kmers(values[offsets[k] : offsets[k + 1]], words)
            else:
                if words not in made:
                    made[words] = _labelled(values, offsets, words)
                all_, starts = made[words]
                grams = all_[starts[k] : starts[k + 1]]
            parts.append(_minima(grams, *kind[:2]) + _names(*kind))
        out.append(mixed(np.concatenate(parts)).view(np.int64))
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("words")
        offsets, values = words.offsets.to_numpy(), words.values.to_numpy().view(np.uint64)
        block = np.cumsum(np.diff(offsets)) // WORDS_AT_ONCE
        cuts = np.append(np.append(0, np.flatnonzero(np.diff(block)) + 1), batch.num_rows)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                rows += _sketches_of(values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ends = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))
        keep = [c for c in batch.schema.names if c != "words"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "sketches"])


def row_key() -> Column:
    """Names a row by id and text; rows that repeat both share it."""
    return F.xxhash64(F.col("doc_id"), whole_text())


def _words() -> Column:
    return F.regexp_extract_all(F.lower(whole_text()), F.lit(WORD), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(first, PAIRS_AT_ONCE)
                sides = []
                for name in ("words_a", "words_b"):
                    column = part.column(name)
                    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
                    sides.append([values[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)])
                linked = similar(list(zip(*sides, strict=True)), similarity)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], ["a", "b", "linked"])

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and word counts of each text, a byte for each bin."""
    for batch in batches:
        offsets, values = batch.column("words").offsets.to_numpy(), batch.column("words").values.to_numpy()
        bins = _bins([values[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)])
        packed = pa.array([x.tobytes() for x in bins.astype(np.uint8)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(np.diff(offsets), pa.int32()), packed], ["text_key", "n", "bins"])


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BINS).astype(np.int16)


def _open(similarity: float):
    """Pairs that sizes and word counts leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(batch.column(f"n_{x}").to_numpy(), _unpacked(batch.column(f"bins_{x}").to_pylist())) for x in "ab"]
            yield batch.select(["a", "b"]).filter(pa.array(_possible(*sides, similarity)))

    return run


def _kind(texts: DataFrame) -> str:
    return texts.schema["text_key"].dataType.simpleString()


def possible_pairs(pairs: DataFrame, marks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``(a, b)`` that may be linked, from ``marks (text_key, n, bins)``; no words are moved."""
    joined = pairs
    for side in "ab":
        named = marks.select(F.col("text_key").alias(side), F.col("n").alias(f"n_{side}"), F.col("bins").alias(f"bins_{side}"))
        joined = joined.join(named, side)
    far = F.abs(F.col("n_a") - F.col("n_b")) > F.greatest("n_a", "n_b") * F.lit(1.0 - similarity) + F.lit(1e-9)
    joined = joined.filter(~far).select("a", "b", "n_a", "n_b", "bins_a", "bins_b")
    return joined.mapInArrow(_open(similarity), f"a {_kind(marks)}, b {_kind(marks)}")


def verify(pairs: DataFrame, texts: DataFrame, marks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b, linked)`` for pairs of text keys, from their whole word sequences; pairs that cannot be linked are left out before."""
    left = texts.select(F.col("text_key").alias("a"), F.col("words").alias("words_a"))
    right = texts.select(F.col("text_key").alias("b"), F.col("words").alias("words_b"))
    joined = possible_pairs(pairs, marks, similarity).join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b")
    return joined.mapInArrow(_verified(similarity), f"a {_kind(texts)}, b {_kind(texts)}, linked boolean")


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets whose texts are not all in one class by now, with their class, its members and all in the bucket."""
    placed = buckets.join(roots, F.col("text_key") == F.col("node"), "left")
    placed = placed.select("bucket", "text_key", F.coalesce("root", "text_key").alias("root"))
    per = placed.groupBy("bucket", "root").agg(F.count("*").alias("in_class"))
    sized = per.groupBy("bucket").agg(F.sum("in_class").alias("members"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return placed.join(per.join(sized, "bucket"), ["bucket", "root"])


def _each(members: DataFrame) -> DataFrame:
    """Pairs of a small bucket's members that are in different classes."""
    a = members.select("bucket", F.col("text_key").alias("a"), F.col("root").alias("root_a"))
    b = members.select("bucket", F.col("text_key").alias("b"), F.col("root").alias("root_b"))
    return a.join(b, "bucket").filter("a < b and root_a <> root_b").select("a", "b")


def _bins(words: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """How many words of each text have a hash of each residue, up to ``MOST_OF_BIN``."""
    out = np.zeros((len(words), bins), np.int16)
    for k, x in enumerate(words):
        out[k] = np.minimum(np.bincount(x & (bins - 1), minlength=bins), MOST_OF_BIN)
    return out


def _possible(one: tuple, two: tuple, similarity: float) -> np.ndarray:
    """Whether lengths and word counts leave a link open, for texts ``(sizes, bins)`` side by side; never false for a linked pair."""
    limits = np.floor((1.0 - similarity) * np.maximum(one[0], two[0]) + 1e-9)
    more = one[1] - two[1]
    return np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= limits


def _earlier(codes: list[np.ndarray], bucket: int) -> np.ndarray:
    """For each member a mark for every large bucket with a smaller number that it is in: pairs with a common mark are compared there."""
    earlier = [x[x < bucket] for x in codes]
    known, place = np.unique(np.concatenate(earlier), return_inverse=True)
    table = np.zeros((len(codes), len(known)), np.float32)
    table[np.repeat(np.arange(len(codes)), [len(x) for x in earlier]), place] = 1
    return table


def _open_pairs(frame: pd.DataFrame, key: tuple, bins: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs ``(a, b)`` of two blocks of a bucket that lengths and word counts leave open and that no earlier bucket has, with class labels."""
    left, right = (np.flatnonzero(frame.block.to_numpy() == k) for k in key[1:3])
    sizes, earlier = frame.n.to_numpy(), _earlier([np.asarray(x, np.int64) for x in frame.codes], key[0])
    label = np.unique(frame.root.to_numpy(), return_inverse=True)[1]
    for first in range(0, len(left), ROWS_AT_ONCE):
        rows = left[first : first + ROWS_AT_ONCE]
        limits = (1.0 - similarity) * np.maximum(sizes[rows][:, None], sizes[right][None, :]) + 1e-9
        open_ = (label[rows][:, None] != label[right][None, :]) & (np.abs(sizes[rows][:, None] - sizes[right][None, :]) <= limits)
        if key[1] == key[2]:
            open_ &= rows[:, None] < right[None, :]
        if open_.any():
            open_ &= earlier[rows] @ earlier[right].T == 0
        a, b = np.nonzero(open_)
        a, b = rows[a], right[b]
        at_once = COUNTS_AT_ONCE // bins.shape[1]
        parts = [slice(k, k + at_once) for k in range(0, len(a), at_once)]
        kept = [_possible((sizes[a[p]], bins[a[p]]), (sizes[b[p]], bins[b[p]]), similarity) for p in parts]
        kept = np.concatenate([*kept, np.zeros(0, bool)])
        yield a[kept], b[kept], label


def _linked_blocks(similarity: float):
    """Links that join the classes of two blocks of a bucket.

    Every pair of unlike classes is excluded by its lengths or word counts, is joined through other links by now, or is aligned.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        words = [np.asarray(x, np.int64) for x in frame.words]
        edges = []
        for a, b, label in _open_pairs(frame, key, _bins(words, FINE_BINS), similarity):
            while True:
                unlike = label[a] != label[b]
                a, b = a[unlike], b[unlike]
                if not len(a):
                    break
                # of a pair of classes one pair at a time: where it is linked, the others need not be aligned
                low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
                now = np.unique(low * len(frame) + high, return_index=True)[1][:PAIRS_AT_ONCE]
                for x, y, linked in zip(a[now], b[now], similar([(words[x], words[y]) for x, y in zip(a[now], b[now], strict=True)], similarity), strict=True):
                    if linked:
                        edges.append((x, y))
                        label[label == label[y]] = label[x]
                a, b = np.delete(a, now), np.delete(b, now)
        keys = frame.text_key.to_numpy()
        return pd.DataFrame({"a": [keys[x] for x, _ in edges], "b": [keys[y] for _, y in edges]}, dtype=object)

    return run


def _open_blocks(similarity: float):
    """Texts of two blocks of a bucket that sizes and word counts leave open to one of another class."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(frame), bool)
        for a, b, _ in _open_pairs(frame, key, _unpacked(frame.bins), similarity):
            found[a] = found[b] = True
        return pd.DataFrame({"bucket": key[0], "text_key": frame.text_key[found].to_numpy()}, dtype=object)

    return run


def _in_blocks(members: DataFrame, weight: Column) -> DataFrame:
    """Members of buckets cut into blocks of bounded size, once for each pair of blocks that they are in."""
    wanted = F.greatest(F.count("*") / F.lit(BLOCK_ROWS), F.sum(weight) / F.lit(BLOCK_WORDS))
    blocks = members.groupBy("bucket").agg(F.ceil(wanted).cast("int").alias("blocks"))
    placed = members.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high")
    return placed.select("bucket", low, high, "block", *[c for c in members.columns if c != "bucket"])


def _block_links(large: DataFrame, texts: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links that join the classes of large buckets ``(bucket, text_key, root)``, whose members are cut into blocks.

    Word counts alone first tell which members may have a partner in another class; only those come with their words.  A pair that shares
    several of these buckets is compared in the first of them: members carry the numbers of theirs.
    """
    kind = _kind(texts)
    # a text is in at most as many buckets as it has sketches
    codes = large.groupBy("text_key").agg(F.sort_array(F.collect_list("bucket")).alias("codes"))
    rows = large.select("bucket", "text_key", "root").join(marks, "text_key").join(codes, "text_key")
    rows = materialize(rows, "large-buckets")
    bucket = rows.schema["bucket"].dataType.simpleString()
    counted = _in_blocks(rows, F.lit(0)).groupBy("bucket", "low", "high")
    open_ = counted.applyInPandas(_open_blocks(similarity), f"bucket {bucket}, text_key {kind}").distinct()
    left = materialize(rows.drop("bins").join(open_, ["bucket", "text_key"], "left_semi"), "open")
    placed = _in_blocks(left, F.col("n")).join(texts, "text_key")
    found = materialize(placed.groupBy("bucket", "low", "high").applyInPandas(_linked_blocks(similarity), f"a {kind}, b {kind}"), "block-links")
    discard(rows)
    discard(left)
    return found


def _unlike(left: DataFrame) -> DataFrame:
    """One of the buckets that have the same members."""
    a, b = F.bit_xor(F.xxhash64("text_key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "text_key")).alias("y")
    once = left.groupBy("bucket").agg(a, b, F.count("*").alias("n")).groupBy("x", "y", "n").agg(F.min("bucket").alias("bucket"))
    return left.join(once.select("bucket"), "bucket")


def _classes(buckets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``(node, root)`` of the texts that are linked, from ``buckets (bucket, text_key)``.

    A text is first compared with two of the smallest members of its buckets, the one it shares most buckets with and the smallest of them,
    and the links so far make classes.  Where a bucket
    still holds several classes, all pairs of unlike classes are settled: up to ``PAIRED`` members are compared with each other,
    more in pairs of blocks by different tasks, from which only links that join classes leave.
    """
    kind = _kind(texts)
    marks = materialize(texts.mapInArrow(_marked, f"text_key {kind}, n int, bins binary"), "marks")
    first = buckets.groupBy("bucket").agg(F.min("text_key").alias("pivot"))
    members = buckets.join(first, "bucket").filter("text_key <> pivot")
    met = members.groupBy("text_key", "pivot").agg(F.count("*").alias("n"))
    best = met.groupBy("text_key").agg(F.array_distinct(F.array(F.min("pivot"), F.max_by("pivot", F.struct("n", "pivot")))).alias("pivots"))
    pairs = best.select(F.explode("pivots").alias("a"), F.col("text_key").alias("b"))
    checked = materialize(verify(pairs, texts, marks, similarity), "checked")
    roots = materialize(components(checked.filter("linked").select("a", "b")), "roots")
    left = materialize(_unlike(_mixed(buckets, roots)), "left-over")
    few, many = left.filter(F.col("members") <= PAIRED), left.filter(F.col("members") > PAIRED)
    pairs = _each(few).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    found = verify(pairs, texts, marks, similarity).filter("linked").select("a", "b")
    if not many.isEmpty():
        found = found.union(_block_links(many, texts, marks, similarity))
    found = materialize(found, "links")
    for done in (marks, checked, left):
        discard(done)
    out = materialize(components(found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
    discard(roots)
    discard(found)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, row_key, class_id, class_size, kept)`` for each row of ``(doc_id, text)``.

    Texts are compared as their words, letters and digits in lower case.  Two texts are linked if they share a sketch and
    their edit similarity on whole word sequences, ``1 - distance / longer length``, is at least ``similarity``; classes are connected
    links.  Texts with equal words are one text from the start; null, empty and wordless texts are equal.
    ``class_id`` is the smallest id of the class, and of its rows one is kept: one with that id, or any if all ids are null.
    ``kept`` is true for all rows that repeat the kept one's id and text.  Besides 10 sketches of three five-word k-mers a text has others for
    scattered edits: 20 of two words up to 15 words, 30 of two two-word k-mers from 12 to 60, 50 of three two-word k-mers from 45 on
    (see ``FURTHER``).  Of texts that share a sketch no pair is left open, however many share it, see ``_classes``: sizes and word
    counts rule most pairs out before any words are moved.
    """
    words = docs.select("doc_id", row_key().alias("row_key"), _words().alias("words"))
    hashed = words.select(
        "doc_id",
        "row_key",
        F.unhex(F.md5(F.array_join("words", " ").cast("binary"))).alias("text_hash"),
        _hashes(F.col("words")).alias("words"),
    )
    id_type = hashed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, row_key bigint, text_hash binary, sketches array<bigint>"
    rows = materialize(hashed.mapInArrow(_sketched, schema), "sketches")
    # equal texts have equal sketches, so any row stands for its text; texts are numbered as they are written
    unique = rows.groupBy("text_hash").agg(F.min(F.struct("row_key", "sketches")).alias("one"))
    unique = unique.select(F.monotonically_increasing_id().alias("text_key"), "text_hash", "one.row_key", "one.sketches")
    unique = materialize(unique, "unique-texts")
    keyed = unique.select("text_key", F.explode("sketches").alias("bucket"))  # the sketches of a text differ by kind and sample
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    buckets = materialize(keyed.join(shared, "bucket"), "buckets")
    asked = materialize(unique.select("text_key", "row_key").join(buckets.select("text_key").distinct(), "text_key"), "asked")
    held = possible_keys(docs.select(row_key().alias("row_key"), whole_text().alias("text")), "row_key", asked, "asked").filter("asked")
    # a text has one row key, so rows that repeat it are together after the join
    held = held.join(asked, "row_key").dropDuplicates(["row_key", "text_key"]).select("text_key", _hashes(_words()).alias("words"))
    held = materialize(held, "words")
    discard(asked)
    roots = _classes(buckets, held, similarity)
    discard(buckets)
    discard(held)
    named = unique.select("text_hash", "text_key").join(roots, F.col("text_key") == F.col("node"), "left")
    named = named.select("text_hash", F.coalesce("root", "text_key").alias("root"))
    placed = materialize(rows.select("doc_id", "row_key", "text_hash").join(named, "text_hash").drop("text_hash"), "placed")
    for done in (rows, unique, roots):
        discard(done)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("key")))
    classes = placed.groupBy("root").agg(first.alias("first"), F.count("*").alias("class_size"))
    return placed.join(classes, "root").select(
        "doc_id",
        "row_key",
        F.col("first.id").alias("class_id"),
        "class_size",
        (F.col("row_key") == F.col("first.key")).alias("kept"),
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns kept, that stand for their class of near-duplicates: one row per class.

    Most rows are kept and are told from the others where they are; only those that go, that repeat, or that a filter of their keys
    takes for such move to be joined.
    """
    found = near_duplicates(docs, similarity)
    keys = found.groupBy(F.col("row_key").alias("__kept")).agg(F.count_if("kept").alias("times"))
    keys = materialize(keys, "kept")
    others = keys.filter("times <> 1").select(F.col("__kept").alias("__row_key"))
    marked = possible_keys(docs.withColumn("__row_key", row_key()), "__row_key", others, "__open")
    sure = marked.filter("not __open").drop("__row_key", "__open")
    left = marked.filter("__open").drop("__open")

    def rows(names: DataFrame) -> DataFrame:
        return left.join(names, F.col("__row_key") == F.col("__kept"), "left_semi")

    single = sure.unionByName(rows(keys.filter("times = 1")).drop("__row_key"))
    repeated = keys.filter("times > 1")
    if repeated.isEmpty():
        return single
    first = rows(repeated).withColumn("__n", F.row_number().over(W.partitionBy("__row_key").orderBy(F.lit(0))))
    return single.unionByName(first.filter("__n = 1").drop("__row_key", "__n"))
