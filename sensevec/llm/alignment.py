"""Banded alignment of word sequences, many pairs at a time."""

from __future__ import annotations

import numpy as np

FIRST_BAND = 16
WIDER = 4  # times
LOOK_EVERY = 64  # rows
CELLS_AT_ONCE = 1 << 18
FAR = np.int32(1 << 29)


def allowed(longer: int, similarity: float) -> int:
    """Edits that leave two sequences similar enough: ``1 - edits / longer >= similarity``."""
    return int((1.0 - similarity) * longer + 1e-9)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common multiset."""
    both, n_a = np.unique(a, return_counts=True)
    other, n_b = np.unique(b, return_counts=True)
    where = np.minimum(np.searchsorted(other, both), len(other) - 1)
    return int(np.minimum(n_a, np.where(other[where] == both, n_b[where], 0)).sum())


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int, limits: np.ndarray) -> np.ndarray:
    """Edit distance of each pair within a band around the diagonal.

    A value above ``band`` only says that the distance is larger.  Rows end early once every pair has passed its limit or is done.
    """
    rows, width = max(len(a) for a, _ in pairs), 2 * band + 1
    left = np.full((len(pairs), rows), -1, np.int64)
    right = np.full((len(pairs), rows + width), -2, np.int64)
    for k, (a, b) in enumerate(pairs):
        left[k, : len(a)] = a
        right[k, band : band + len(b)] = b
    sizes = np.array([(len(a), len(b)) for a, b in pairs])
    end = sizes[:, 1] - sizes[:, 0] + band
    ramp = np.arange(width, dtype=np.int32)
    now = np.broadcast_to(np.where(ramp >= band, ramp - band, FAR).astype(np.int32), (len(pairs), width)).copy()
    found = np.full(len(pairs), FAR, np.int32)
    for i in range(rows + 1):
        done = np.flatnonzero(sizes[:, 0] == i)
        found[done] = now[done, end[done]]
        if i == rows or i % LOOK_EVERY == 0 and not ((now.min(1) <= limits) & (sizes[:, 0] > i)).any():
            break
        new = now + (right[:, i : i + width] != left[:, i, None])
        np.minimum(new[:, :-1], now[:, 1:] + 1, out=new[:, :-1])
        now = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return found


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """Whether each pair of sequences has ``1 - distance / longer length >= similarity``.

    Lengths and common words rule pairs out first, and equal ends are cut off.  What is left is aligned in a band that starts at
    what the common words ask for and widens until it holds the distance or exceeds the edits allowed.  Two empty sequences are similar.
    """
    out = np.zeros(len(pairs), bool)
    todo = []
    for k, (a, b) in enumerate(pairs):
        longer, shorter = max(len(a), len(b)), min(len(a), len(b))
        limit = allowed(longer, similarity)
        if longer - shorter > limit:
            continue
        least = longer - (common_words(a, b) if shorter else 0)
        if least > limit:
            continue
        differ = np.flatnonzero(a[:shorter] != b[:shorter])
        head = int(differ[0]) if len(differ) else shorter
        a, b, shorter = a[head:], b[head:], shorter - head
        differ = np.flatnonzero(a[len(a) - shorter :][::-1] != b[len(b) - shorter :][::-1])
        tail = int(differ[0]) if len(differ) else shorter
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a) or not len(b):
            out[k] = max(len(a), len(b)) <= limit
        else:
            band = FIRST_BAND
            while band < least:
                band *= WIDER
            todo.append((band, len(a), k, a, b, limit))
    while todo:
        todo.sort(key=lambda x: x[:2])
        band, size = todo[0][:2]
        most = max(1, CELLS_AT_ONCE // (2 * band + 1 + size))
        part = [x for x in todo[:most] if x[0] == band and x[1] <= 4 * size + LOOK_EVERY]
        todo = todo[len(part) :]
        distances = banded([x[3:5] for x in part], band, np.array([x[5] for x in part]))
        for (_, size, k, a, b, limit), distance in zip(part, distances, strict=True):
            if distance <= min(band, limit):
                out[k] = True
            elif distance > band and band < limit:
                todo.append((WIDER * band, size, k, a, b, limit))
    return out
