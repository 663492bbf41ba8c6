"""Periodic runs of words by recompression: a run-length grammar answers the extensions of candidates on harmonic grids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = "[\x20\x09-\x0d]+"
SHORTEST = 12  # words of a run
WORDS_AT_ONCE = 400_000  # of the texts that share a grammar; a longer text has its own
CANDIDATES_AT_ONCE = 1 << 19
SEED = 0x9E3779B97F4A7C15


@dataclass
class Level:
    """A sequence of symbols and how the next level groups it."""

    symbols: np.ndarray
    parent: np.ndarray | None = None  # place of a symbol's group in the next level
    first: np.ndarray | None = None  # where each group begins, and the end
    blocks: bool = False  # groups are repeats of one symbol, else pairs and single symbols


def _grouped(symbols: np.ndarray, begins: np.ndarray, names: np.ndarray, blocks: bool) -> tuple[Level, np.ndarray]:
    parent = np.cumsum(begins) - 1
    first = np.append(np.flatnonzero(begins), len(symbols))
    return Level(symbols, parent.astype(np.int32), first.astype(np.int32), blocks), names


def _blocks(symbols: np.ndarray) -> tuple[Level, np.ndarray]:
    """Every maximal repeat of a symbol becomes one symbol, named by symbol and length."""
    begins = np.append(True, symbols[1:] != symbols[:-1])
    first = np.flatnonzero(begins)
    length = np.diff(np.append(first, len(symbols)))
    heads = symbols[first].astype(np.int64)
    return _grouped(symbols, begins, pd.factorize(heads << 32 | length)[0], True)


def _pairs(symbols: np.ndarray, fixed: np.ndarray, seed: int) -> tuple[Level, np.ndarray]:
    """Symbols fall into a left and a right half; each left one followed by a right one becomes a pair."""
    mix = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(SEED + 2 * seed)
    side = ((mix ^ (mix >> np.uint64(29))) * np.uint64(SEED) >> np.uint64(47)).astype(np.int8) & 1
    side[fixed] = -1
    joins = [(side[:-1] == a) & (side[1:] == 1 - a) for a in (0, 1)]
    joined = max(joins, key=np.count_nonzero)
    begins = np.append(True, ~joined)
    first = np.flatnonzero(begins)
    heads = symbols[first].astype(np.int64)
    paired = np.append(joined, False)[first]
    second = np.where(paired, symbols[np.minimum(first + 1, len(symbols) - 1)].astype(np.int64) + 1, 0)
    return _grouped(symbols, begins, pd.factorize(heads << 32 | second)[0], False)


class Grammar:
    """Recompression of texts laid side by side, with a border symbol before, between and after them.

    Block and pair compression alternate until every text is one symbol.  Equal stretches are grouped alike but for their ends, so the
    common extension of two places climbs the levels while symbols agree and comes down where they differ.
    """

    def __init__(self, words: np.ndarray, borders: np.ndarray):
        """``borders`` are the places of border symbols, each of which occurs once."""
        self.levels, symbols, fixed, turn = [], words, borders, 0
        while len(symbols) > 2 * len(fixed) - 1:
            for step in (_blocks, lambda s: _pairs(s, fixed, turn)):  # noqa: B023  used at once
                level, symbols = step(symbols)
                self.levels.append(level)
                fixed = level.parent[fixed]
            turn += 1
        self.levels.append(Level(symbols))

    def _next(self, level: Level, i: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Group of each place, and how many symbols of the group are left from it on."""
        group = level.parent[i]
        return group, level.first[group + 1] - i if forward else i - level.first[group] + 1

    def extend(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols agree from places ``i`` and ``j`` on, or back from them; a border agrees with nothing."""
        sign = 1 if forward else -1
        start, out = i, np.zeros(len(i), np.int64)
        i, j, who = i.copy(), j.copy(), np.arange(len(i))
        apart: list[tuple] = []
        for level in self.levels:
            same = level.symbols[i] == level.symbols[j]
            if level.parent is None or not same.any():
                apart.append((who, i, j))
                break
            lost = [(who[~same], i[~same], j[~same])]
            who, i, j = who[same], i[same], j[same]
            (up_i, left_i), (up_j, left_j) = (self._next(level, x, forward) for x in (i, j))
            sizes = np.diff(level.first)
            inside = (left_i != sizes[up_i]) | (left_j != sizes[up_j])
            if inside.any():
                at = np.flatnonzero(inside)
                step = np.minimum(left_i[at], left_j[at]) * sign
                i[at], j[at] = i[at] + step, j[at] + step
                differ = at[level.symbols[i[at]] != level.symbols[j[at]]]
                lost.append((who[differ], i[differ], j[differ]))
                keep = np.ones(len(i), bool)
                keep[differ] = False
                who, i, j = who[keep], i[keep], j[keep]
                up_i, up_j = level.parent[i], level.parent[j]
            apart.append(tuple(np.concatenate(x) for x in zip(*lost, strict=True)))
            i, j = up_i.astype(i.dtype), up_j.astype(j.dtype)
        who, i, j = apart.pop()
        while apart:
            level = self.levels[len(apart) - 1]
            if forward:
                i, j = level.first[i].astype(i.dtype), level.first[j].astype(j.dtype)
            else:
                i, j = level.first[i + 1].astype(i.dtype) - 1, level.first[j + 1].astype(j.dtype) - 1
            same = np.flatnonzero(level.symbols[i] == level.symbols[j])
            if len(same):
                left_i, left_j = (self._next(level, x[same], forward)[1] for x in (i, j))
                step = (np.minimum(left_i, left_j) if level.blocks else 1) * sign
                i[same], j[same] = i[same] + step, j[same] + step
            more = apart.pop()
            who, i, j = np.concatenate([who, more[0]]), np.concatenate([i, more[1]]), np.concatenate([j, more[2]])
        out[who] = (i - start[who]) * sign
        return out


def _candidates(words: np.ndarray, sizes: np.ndarray, begins: np.ndarray, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(place, period)`` where the words a period apart agree, on a grid of each period that no run slips through.

    A run of period q and length L has ``L - q`` places that agree with the one q later, at least ``max(q, shortest - q)``; the grid's step is that.
    Texts lie from the longest to the shortest, so a period looks only at those that can hold it twice.
    """
    place, period, held = [], [], 0
    longest = int(sizes[0]) if len(sizes) else 0
    for q in range(1, longest // 2 + 1):
        fit = int(np.searchsorted(-sizes, -max(2 * q, shortest), side="right"))
        if not fit:
            break
        end = int(begins[fit - 1] + sizes[fit - 1])
        step = max(q, shortest - q)
        hits = np.flatnonzero(words[1 : end - q : step] == words[1 + q : end : step]) * step + 1
        if len(hits):
            place.append(hits)
            period.append(np.full(len(hits), q))
            held += len(hits)
        if held >= CANDIDATES_AT_ONCE:
            yield np.concatenate(place), np.concatenate(period)
            place, period, held = [], [], 0
    if held:
        yield np.concatenate(place), np.concatenate(period)


def find_runs(texts: list[np.ndarray], shortest: int = SHORTEST) -> list[np.ndarray]:
    """All runs of each sequence of word numbers: rows ``start, length, period`` by start, then period.

    A run is a stretch with smallest period q that no neighbour extends, of at least ``max(shortest, 2 * q)`` words.
    """
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    long = [k for k in np.argsort([-len(x) for x in texts], kind="stable") if len(texts[k]) >= shortest]
    if not long:
        return out
    most = max(int(texts[k].max()) for k in long) + 1
    parts, begins, at = [np.array([most])], [], 1
    for n, k in enumerate(long):
        begins.append(at)
        parts += [texts[k], np.array([most + 1 + n])]
        at += len(texts[k]) + 1
    words, begins = np.concatenate(parts).astype(np.int32), np.array(begins)
    sizes = np.array([len(texts[k]) for k in long])
    grammar = Grammar(words, np.append(0, begins + sizes))
    found = [np.zeros((0, 3), np.int64)]
    for place, period in _candidates(words, sizes, begins, shortest):
        ahead = grammar.extend(place, place + period)
        back = grammar.extend(place - 1, place + period - 1, forward=False)
        length = ahead + back + period
        keep = length >= np.maximum(shortest, 2 * period)
        # a stretch is met with its period and the multiples of it, the smallest of which is its own
        rows = np.stack([place - back, length, period], 1)[keep]
        found.append(rows[_first_of(rows)])
    runs = np.concatenate(found)
    runs = runs[_first_of(runs)]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs[:, 0] -= begins[owner]
    cuts = np.searchsorted(owner, np.arange(len(long) + 1))
    for n, k in enumerate(long):
        out[k] = runs[cuts[n] : cuts[n + 1]]
    return out


def _first_of(rows: np.ndarray) -> np.ndarray:
    """Rows with the smallest period among those of one stretch."""
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    ordered = rows[order]
    return order[np.append(True, (ordered[1:, :2] != ordered[:-1, :2]).any(1))] if len(rows) else order


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: it goes if a run holds it after its first period."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def repeated_tail(doc_id: int, size: int) -> np.ndarray:
    """Which word stands at each place once the tail of every tenth document, by the hash of its id, is made periodic."""
    places, h = np.arange(size), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and size:
        g = h // 10
        a = g % size
        p = 1 + (size - a) // (3 + g % 8)
        places[a:] = a + (places[a:] - a) % p
    return places


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts in a row, how many each text has, and the words."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), SPACES)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    named = pc.dictionary_encode(flat)
    codes, words = named.indices.to_numpy(), named.dictionary
    empty = pc.index(words, "").as_py()
    real = codes != empty if empty >= 0 else np.ones(len(codes), bool)
    before = np.append(0, np.cumsum(real))
    return codes[real], np.diff(before[offsets - offsets[0]]), words


def _part(ids: list, texts: pa.Array, tails: bool, shortest: int) -> list[pa.Array]:
    codes, sizes, words = split_words(texts)
    ends = np.cumsum(sizes)
    docs = [codes[b - n : b] for b, n in zip(ends, sizes, strict=True)]
    if tails:
        docs = [x if i is None else x[repeated_tail(i, len(x))] for i, x in zip(ids, docs, strict=True)]
    names = np.array(words.to_pylist(), object)
    kept, flat, counts = [], [], []
    for doc, runs in zip(docs, find_runs(docs, shortest), strict=True):
        kept.append(" ".join(names[doc[kept_words(len(doc), runs)]].tolist()))
        flat.append(runs)
        counts.append(len(runs))
    rows = np.concatenate([*flat, np.zeros((0, 3), np.int64)])
    runs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), runs)
    return [pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.string())]


def _collapsed(tails: bool, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy() // 6 + 1
            block = np.cumsum(size) // WORDS_AT_ONCE
            cuts = np.append(np.append(0, np.flatnonzero(np.diff(block)) + 1), batch.num_rows)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    ids = batch.column("doc_id").slice(a, b - a)
                    columns = [ids, *_part(ids.to_pylist(), texts.slice(a, b - a), tails, shortest)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def collapse(docs: DataFrame, tails: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of each row of ``(doc_id, text)``, from its whole text.

    Words are maximal stretches without blank, tab, line and form feed, carriage return.  ``runs`` lists ``(start, length, period)`` by
    start, then period; ``collapsed`` joins by one blank the words that no run holds after its first period.  A null, empty or blank text has no
    words.  ``tails`` first makes the tail of every tenth document periodic, see ``repeated_tail``; a row with a null id stays as it is.
    Rows stay where they are and are answered each; texts of a batch share a grammar up to ``WORDS_AT_ONCE`` words.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {id_type}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(_collapsed(tails, shortest), schema)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest one, digests of all runs and of the collapsed text."""
    found = collapse(docs, tails=True)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # the greatest length, of equal ones the smallest start, then period
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    top = found.select(
        "doc_id",
        "n_words",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.array_max(order).alias("top"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return top.select(
        "doc_id",
        "n_runs",
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
        "n_words",
    )
