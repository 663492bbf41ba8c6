"""Arrow kernels that run inside tasks; Spark has partitioned and grouped the rows before.

Only numpy and pyarrow are used here, so the module can be shipped to the workers by value.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 4096


ROWS = 1 << 17  # occurrences or pairs that are scored together, and so share the pairs among them
HOT = 2048  # most frequent words, whose pairs a worker may keep scored
QUERIES_AT_ONCE = 1024  # whose products with a block of candidates are held together
KEPT_BYTES = 32 << 20  # scores of other pairs that a worker keeps, the first it meets


class Decoder:
    """Node vectors and word paths as arrays; row ``i`` belongs to id ``i``."""

    def __init__(self, out: np.ndarray, start: np.ndarray, node: np.ndarray, code: np.ndarray):
        self.out, self.start, self.node, self.code = out, start, node, code
        self.wide: np.ndarray | None = None

    def paths(self, words: np.ndarray):
        """Flattened steps of the paths of ``words`` and where each path begins."""
        first = self.start[words]
        length = self.start[words + 1] - first
        begin = np.cumsum(length) - length
        step = np.arange(length.sum()) - np.repeat(begin - first, length)
        return self.node[step], self.code[step], begin, length

    def scores(self, nodes: np.ndarray, vectors: np.ndarray):
        """``f`` per distinct node and sense, with the node of each row and the row of each step.

        A list of steps about as long as the tree is answered from all nodes, a short one from those it names.
        """
        if len(nodes) * 2 >= len(self.out):
            if self.wide is None:
                self.wide = self.out.astype(np.float64)
            return None, nodes, self.wide @ vectors.T
        uniq, inverse = np.unique(nodes, return_inverse=True)
        return uniq, inverse, self.out[uniq].astype(np.float64) @ vectors.T

    def loglik(self, vectors: np.ndarray, words: np.ndarray) -> np.ndarray:
        """``log p(word | sense)`` with one row per word and one column per vector."""
        out = np.zeros((len(words), len(vectors)))
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            node, code, begin, length = self.paths(part)
            if not len(node):
                continue
            _, row, f = self.scores(node, vectors)
            ls = np.minimum(f, 0.0) - np.log1p(np.exp(-np.abs(f)))
            # log sigmoid(-f) = log sigmoid(f) - f, so one table serves both branches
            both = np.concatenate([ls, ls - f])
            has = length > 0
            out[at : at + CHUNK][has] = np.add.reduceat(both[row + code * np.int64(len(f))], begin[has], axis=0)
        return out


def list_column(values: np.ndarray, width: int) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).reshape(-1))
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * width, flat)


def lists_of(column: pa.Array):
    """Offsets and flat values of a list column, aware of slicing."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten()


def scored_rows(decoder: Decoder, batch: pa.RecordBatch):
    """For every ``(vecs, pi, ps)`` row: its number, senses, their priors, partners, counts and log-likelihoods."""
    vecs, pis = batch.column("vecs"), batch.column("pi")
    offsets, pairs = lists_of(batch.column("ps"))
    y, n = pairs.field("y").to_numpy(), pairs.field("n").to_numpy()
    for r in range(batch.num_rows):
        a, b = offsets[r], offsets[r + 1]
        ks, vectors = sense_matrix(vecs[r])
        yield r, ks, np.asarray(pis[r].values)[ks], y[a:b], n[a:b], decoder.loglik(vectors, y[a:b])


def log_mixture(ll: np.ndarray, prior: np.ndarray, min_prob: float) -> np.ndarray | None:
    """``log sum_k prior_k exp(ll_k)`` per row over the senses that matter; None if there is none."""
    use = prior >= min_prob
    if not use.any():
        return None
    terms = ll[:, use] + np.log(prior[use])
    top = terms.max(axis=1)
    return top + np.log(np.exp(terms - top[:, None]).sum(axis=1))


def _pair_columns(batch: pa.RecordBatch, rows: list) -> list:
    """``x, y, n`` columns of the partners in ``rows`` of ``(row number, y, n)``."""
    xs = batch.column("x").to_numpy()
    x = np.concatenate([np.full(len(y), xs[r], dtype=np.int32) for r, y, _ in rows])
    return [pa.array(x), pa.array(np.concatenate([y for _, y, _ in rows])), pa.array(np.concatenate([n for _, _, n in rows]))]


def pair_scorer(shared, senses: int):
    """Kernel over packed pairs; emits the array of log-likelihoods per pair."""

    def run(batches):
        decoder = Decoder(*shared.value)
        for batch in batches:
            rows, results = [], []
            for r, ks, _, y, n, ll in scored_rows(decoder, batch):
                full = np.full((len(y), senses), -np.inf)
                full[:, ks] = ll
                rows.append((r, y, n))
                results.append(full)
            if rows:
                columns = [*_pair_columns(batch, rows), list_column(np.concatenate(results), senses)]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "n", "ll"])

    return run


def pair_valuer(shared, min_prob: float):
    """Kernel over packed pairs; emits the prior-weighted log-probability per pair."""

    def run(batches):
        decoder = Decoder(*shared.value)
        for batch in batches:
            rows, results = [], []
            for r, _, prior, y, n, ll in scored_rows(decoder, batch):
                value = log_mixture(ll, prior, min_prob)
                if value is not None:
                    rows.append((r, y, n))
                    results.append(value)
            if rows:
                columns = [*_pair_columns(batch, rows), pa.array(np.concatenate(results))]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "n", "v"])

    return run


def pair_averager(shared, min_prob: float):
    """Kernel over packed pairs; emits one count-weighted mean per row."""

    def run(batches):
        decoder = Decoder(*shared.value)
        for batch in batches:
            means, sizes = [], []
            for _, _, prior, _, n, ll in scored_rows(decoder, batch):
                value = log_mixture(ll, prior, min_prob)
                if value is not None and n.sum() > 0:
                    sizes.append(int(n.sum()))
                    means.append(float(value @ n) / sizes[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(means, pa.float64()), pa.array(sizes, pa.int64())], names=["mean", "n"]
            )

    return run


def group_codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's combination of values, and a row where each number occurs."""
    codes = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        named = column.dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * (len(named.dictionary) + 1) + named.indices.to_numpy(), return_inverse=True)[1]
    return codes, np.unique(codes, return_index=True)[1]


def group_averager(shared, min_prob: float, keys: list[str]):
    """Kernel over pairs packed with the groups they occur in; emits one sum and count per row and group."""

    def run(batches):
        decoder = Decoder(*shared.value)
        for batch in batches:
            vecs, pis = batch.column("vecs"), batch.column("pi")
            offsets, pairs = lists_of(batch.column("ps"))
            if not len(pairs):
                continue
            y, n = pairs.field("y").to_numpy(), pairs.field("n").to_numpy()
            codes, example = group_codes([pairs.field(k) for k in keys])
            groups, sums, sizes = [], [], []
            for r in range(batch.num_rows):
                a, b = offsets[r], offsets[r + 1]
                ks, vectors = sense_matrix(vecs[r])
                words, place = np.unique(y[a:b], return_inverse=True)
                value = log_mixture(decoder.loglik(vectors, words), np.asarray(pis[r].values)[ks], min_prob)
                if value is not None:
                    mine, at = np.unique(codes[a:b], return_inverse=True)
                    groups.append(mine)
                    sums.append(np.bincount(at, value[place] * n[a:b]))
                    sizes.append(np.bincount(at, n[a:b]).astype(np.int64))
            if groups:
                rows = pa.array(example[np.concatenate(groups)])
                columns = [pairs.field(k).take(rows) for k in keys]
                columns += [pa.array(np.concatenate(sums)), pa.array(np.concatenate(sizes))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "s", "n"])

    return run


def sum_by(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` added up by ``index``."""
    return np.stack([np.bincount(index, values[:, k], size) for k in range(values.shape[1])], axis=1)


def posterior(decoder: Decoder, vectors: np.ndarray, start_z: np.ndarray, ctx: np.ndarray, offsets: np.ndarray):
    """Sense probabilities per occurrence, and the log-likelihood rows behind them."""
    words, inverse = np.unique(ctx, return_inverse=True)
    ll = decoder.loglik(vectors, words)
    z = np.tile(start_z, (len(offsets) - 1, 1))
    length = np.diff(offsets)
    has = length > 0
    if has.any():
        z[has] += np.add.reduceat(ll[inverse], offsets[:-1][has], axis=0)
    top = z.max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        z = np.exp(z - top)
        z /= z.sum(axis=1, keepdims=True)
    return z, words, inverse, ll


def sense_matrix(row) -> tuple[np.ndarray, np.ndarray]:
    """Sense numbers (from 0) and vectors of one ``array<struct<sense, vec>>`` cell, in sense order."""
    values = row.values
    ks = values.field("sense").to_numpy() - 1
    offsets, flat = lists_of(values.field("vec"))
    vecs = flat.to_numpy(zero_copy_only=False).reshape(len(ks), -1).astype(np.float64)
    order = np.argsort(ks)
    return ks[order], vecs[order]


def posterior_scorer(shared, senses: int):
    """Kernel over ``(vecs, start_z, occs)`` slices; emits ``(occ_id, z)``, ``z`` NULL if no sense is left."""

    def run(batches):
        decoder = Decoder(*shared.value)
        for batch in batches:
            start_z = batch.column("start_z")
            vecs = batch.column("vecs")
            occ_offsets, occs = lists_of(batch.column("occs"))
            ctx_offsets, ctx = lists_of(occs.field("ctx"))
            ctx = ctx.to_numpy()
            out = np.zeros((len(occs), senses))
            for r in range(batch.num_rows):
                a, b = occ_offsets[r], occ_offsets[r + 1]
                ks, vectors = sense_matrix(vecs[r])
                start = np.asarray(start_z[r].values)[ks]
                off = ctx_offsets[a : b + 1]
                z, _, _, _ = posterior(decoder, vectors, start, ctx[off[0] : off[-1]], off - off[0])
                out[a:b, ks] = z
            lost = ~np.isfinite(out).all(axis=1)
            column = list_column(out, senses)
            if lost.any():
                column = pa.array([None if bad else v for bad, v in zip(lost, column.to_pylist())], column.type)
            yield pa.RecordBatch.from_arrays([occs.field("occ_id"), column], names=["occ_id", "z"])

    return run


class Words:
    """Vectors and starting values of all words as arrays beside the decoder; row ``i`` belongs to id ``i``.

    ``base`` is infinity for unknown words and minus infinity for senses without a vector.  Ids rank words by frequency, so the pairs among
    the first ``HOT`` ids are most of a text; once a worker has met enough of them it scores them all and keeps the table.
    """

    def __init__(self, decoder: Decoder, vecs: np.ndarray, base: np.ndarray, kept: dict):
        self.decoder, self.vecs, self.base, self.kept = decoder, vecs, base, kept
        self.size, self.senses = base.shape
        self.hot = min(HOT, self.size)
        start = decoder.start
        steps = int(np.diff(start).max(initial=0))
        reach = np.abs(vecs).max(initial=0.0) * np.abs(decoder.out).max(initial=0.0) * vecs.shape[2]
        # a product of ``1 + exp(..)`` over the path takes one logarithm; far values take one a step instead
        self.plain = bool(steps * (float(reach) + 1.0) < 600.0)
        # last axis is the longest, as all steps run along it
        self.out = np.ascontiguousarray(decoder.out.T.astype(np.float64))

    def known(self, x: np.ndarray) -> np.ndarray:
        inside = (x >= 0) & (x < self.size)
        return inside & ~np.isposinf(self.base[np.where(inside, x, 0), 0])

    def distinct(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``log p(y | x, sense)``, a row per pair and a column per sense, of pairs sorted by ``x``."""
        out = np.zeros((len(x), self.senses))
        first, last = self.decoder.start[y], self.decoder.start[y + 1]
        for at in range(0, len(x), CHUNK):
            length = (last - first)[at : at + CHUNK]
            order = np.argsort(-length, kind="stable")
            begin, length = first[at : at + CHUNK][order], length[order]
            vec = np.ascontiguousarray(self.vecs[x[at : at + CHUNK][order]].astype(np.float64).transpose(2, 1, 0))
            total = np.ones(vec.shape[1:]) if self.plain else np.zeros(vec.shape[1:])
            for step in range(int(length[0]) if len(length) else 0):
                n = int(np.searchsorted(-length, -step, side="left"))  # paths longer than ``step``
                node = self.decoder.node[begin[:n] + step]
                cell = self.out[:, node]
                f = vec[0, :, :n] * cell[0]
                for d in range(1, len(cell)):
                    f += vec[d, :, :n] * cell[d]
                f *= 2.0 * self.decoder.code[begin[:n] + step] - 1.0
                if self.plain:
                    np.exp(f, out=f)
                    f += 1.0
                    total[:, :n] *= f
                else:
                    total[:, :n] += np.logaddexp(0.0, f)
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            out[at : at + CHUNK] = 0.0 - (np.log(total) if self.plain else total).T[back]
        return out

    def table(self) -> np.ndarray | None:
        """All pairs among the first ids, once this worker has met as many of them as the table has."""
        if "table" not in self.kept and self.kept.get("met", 0) >= self.hot * self.hot:
            words = np.arange(self.hot)
            flat = np.empty((self.hot, self.hot, self.senses))
            for x in range(0, self.hot, 32):
                part = self.vecs[x : min(x + 32, self.hot)].astype(np.float64)
                flat[x : x + 32] = self.decoder.loglik(part.reshape(-1, part.shape[2]), words).reshape(self.hot, -1, self.senses).transpose(1, 0, 2)
            self.kept["table"] = flat.reshape(-1, self.senses)
        return self.kept.get("table")

    def loglik(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """:meth:`distinct` for pairs in any order, each different pair scored once."""
        x, y = x.astype(np.int64), y.astype(np.int64)
        hot = (x < self.hot) & (y < self.hot)
        self.kept["met"] = self.kept.get("met", 0) + int(hot.sum())
        table = self.table()
        if table is None:
            return self._different(x, y)
        out = np.empty((len(x), self.senses))
        out[hot] = table[x[hot] * self.hot + y[hot]]
        out[~hot] = self._different(x[~hot], y[~hot])
        return out

    def _different(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, self.senses))
        # two halves of a word: faster to sort than rows of two
        pairs, place = np.unique(x << 32 | y, return_inverse=True)
        return self._scored(pairs)[place]

    def _scored(self, pairs: np.ndarray) -> np.ndarray:
        """:meth:`distinct` for sorted pairs; what this worker has scored and kept is not scored again."""
        codes, values = self.kept.get("pairs", (np.empty(0, np.int64), np.empty((0, self.senses))))
        at = np.searchsorted(codes, pairs)
        had = at < len(codes)
        had[had] = codes[at[had]] == pairs[had]
        fresh = pairs[~had]
        out = np.empty((len(pairs), self.senses))
        out[had] = values[at[had]]
        out[~had] = found = self.distinct(fresh >> 32, fresh & 0xFFFFFFFF)
        if len(fresh) and (len(codes) + len(fresh)) * 8 * (self.senses + 1) <= KEPT_BYTES:
            every = np.concatenate([codes, fresh])
            order = np.argsort(every, kind="stable")
            self.kept["pairs"] = every[order], np.concatenate([values, found])[order]
        return out


def words_of(shared, words) -> Words:
    """``words`` is a broadcast of ``(vecs, base, kept, n_senses)``; what a task keeps there serves later tasks of its worker."""
    vecs, base, kept, _ = words.value
    return Words(Decoder(*shared.value), vecs, base, kept)


def gathered(batches, rows: int = ROWS):
    """Batches of about ``rows`` rows, of smaller ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def context_scores(words: Words, batch: pa.RecordBatch):
    """Rows of ``(occ_id, x, ctx)`` whose word is known, the summed log-likelihoods of their contexts, and which have one."""
    x = batch.column("x").to_numpy(zero_copy_only=False)
    batch = batch.filter(pa.array(words.known(x)))
    x = batch.column("x").to_numpy()
    offsets, ctx = lists_of(batch.column("ctx"))
    length = np.diff(offsets)
    has = length > 0
    sums = np.zeros((len(x), words.senses))
    if has.any():
        ll = words.loglik(np.repeat(x, length), ctx.to_numpy())
        sums[has] = np.add.reduceat(ll, offsets[:-1][has], axis=0)
    return batch, x, sums, has


def occurrence_scorer(shared, side):
    """Kernel over ``(occ_id, x, ctx)`` in any order; emits ``(occ_id, z)``, ``z`` NULL if no sense is left."""

    def run(batches):
        words = words_of(shared, side)
        for batch in gathered(batches):
            batch, x, sums, _ = context_scores(words, batch)
            z = words.base[x] + sums
            with np.errstate(invalid="ignore"):
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
            lost = ~np.isfinite(z).all(axis=1)
            column = list_column(z, words.senses)
            if lost.any():
                column = pc.if_else(pa.array(lost), pa.scalar(None, column.type), column)
            yield pa.RecordBatch.from_arrays([batch.column("occ_id"), column], names=["occ_id", "z"])

    return run


def context_scorer(shared, side):
    """Kernel over ``(occ_id, x, ctx)``; emits ``(occ_id, ll)`` of contexts that are not empty, minus infinity for missing senses."""

    def run(batches):
        words = words_of(shared, side)
        for batch in gathered(batches):
            batch, x, sums, has = context_scores(words, batch)
            ll = np.where(np.isneginf(words.base[x]), -np.inf, sums)[has]
            yield pa.RecordBatch.from_arrays(
                [batch.column("occ_id").filter(pa.array(has)), list_column(ll, words.senses)], names=["occ_id", "ll"]
            )

    return run


def mixture_averager(shared, side, keys: list[str]):
    """Kernel over counted pairs ``(keys, x, y, n)`` in any order; ``base`` holds log priors of the senses that matter.

    Emits sum and count of the groups in a batch.
    """

    def run(batches):
        words = words_of(shared, side)
        for batch in gathered(batches, 4 * ROWS):
            x = batch.column("x").to_numpy(zero_copy_only=False)
            base = words.base[np.where(words.known(x), x, 0)]
            some = words.known(x) & np.isfinite(base).any(axis=1)
            batch, base = batch.filter(pa.array(some)), base[some]
            if not batch.num_rows:
                continue
            y, n = batch.column("y").to_numpy(), batch.column("n").to_numpy()
            terms = base + words.loglik(batch.column("x").to_numpy(), y)
            top = terms.max(axis=1)
            value = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
            if not keys:
                yield pa.RecordBatch.from_arrays([pa.array([float(value @ n)]), pa.array([int(n.sum())])], names=["s", "n"])
                continue
            codes, example = group_codes([batch.column(k) for k in keys])
            sizes = np.bincount(codes, n, len(example)).astype(np.int64)
            columns = [batch.column(k).take(pa.array(example)) for k in keys]
            columns += [pa.array(np.bincount(codes, value * n, len(example))), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "s", "n"])

    return run


def flat_pair_scorer(shared, side):
    """Kernel over pairs ``(x, y, n)``; emits them with ``ll``, minus infinity for missing senses."""

    def run(batches):
        words = words_of(shared, side)
        for batch in batches:
            batch = batch.filter(pa.array(words.known(batch.column("x").to_numpy(zero_copy_only=False))))
            x = batch.column("x").to_numpy()
            ll = words.loglik(x, batch.column("y").to_numpy())
            ll = np.where(np.isneginf(words.base[x]), -np.inf, ll)
            columns = [batch.column(c) for c in ("x", "y", "n")]
            yield pa.RecordBatch.from_arrays([*columns, list_column(ll, words.senses)], names=["x", "y", "n", "ll"])

    return run


def round_scorer(shared, senses: int, lr: float, threshold: float):
    """Kernel of one training round over ``(x, freq, vecs, start_z, occs)`` slices.

    The model is fixed during the round.  Emits partial sums ``(kind, id, sense, weight, n, vec)``:
    kind 0 is the gradient of a sense vector, 1 that of a node vector (already summed over the whole task),
    2 the summed posteriors of a word (``n`` occurrences), 3 the log-likelihood of the task.  Where occurrences tell how many
    of their word stand ``behind`` them, posteriors are weighted by ``(1 - lr) ** behind``.
    """

    def run(batches):
        decoder = Decoder(*shared.value)
        size, dim = decoder.out.shape
        out_grad = np.zeros((size, dim))
        out_weight = np.zeros(size)
        ll_sum, ll_n, occurrences = 0.0, 0, 0
        sense_sum, sense_max = 0.0, 0
        for batch in batches:
            rows = []
            xs = batch.column("x").to_numpy()
            start_z, n_senses = batch.column("start_z"), batch.column("n_senses").to_numpy()
            vecs = batch.column("vecs")
            occ_offsets, occs = lists_of(batch.column("occs"))
            ctx_offsets, ctx = lists_of(occs.field("ctx"))
            ctx = ctx.to_numpy()
            late = None
            if occs.type.get_field_index("behind") >= 0:
                late = (1.0 - lr) ** occs.field("behind").to_numpy().astype(np.float64)
            for r in range(batch.num_rows):
                a, b = occ_offsets[r], occ_offsets[r + 1]
                ks, vectors = sense_matrix(vecs[r])
                off = ctx_offsets[a : b + 1]
                z, words, inverse, ll = posterior(
                    decoder, vectors, np.asarray(start_z[r].values)[ks], ctx[off[0] : off[-1]], off - off[0]
                )
                occurrences += b - a
                sense_sum += float(n_senses[r]) * (b - a)
                sense_max = max(sense_max, int(n_senses[r]))
                full = np.zeros(senses)
                full[ks] = z.sum(axis=0) if late is None else late[a:b] @ z
                rows.append((2, int(xs[r]), 0, 0.0, b - a, full))
                if not len(words):
                    continue
                # weight of each (word, sense): posteriors summed over the occurrences beside the word
                kept = np.where(z >= threshold, z, 0.0)
                per_pair = np.repeat(kept, np.diff(off), axis=0)
                weight = sum_by(inverse, per_pair, len(words))
                ll_sum += float((weight * ll).sum())
                ll_n += len(inverse)
                node, code, begin, length = decoder.paths(words)
                if not len(node):
                    continue
                uniq, place, f = decoder.scores(node, vectors)
                uniq = np.arange(size) if uniq is None else uniq
                step_weight = np.repeat(weight, length, axis=0)
                total = sum_by(place, step_weight, len(uniq))
                ones = sum_by(place, step_weight * code[:, None], len(uniq))
                pull = total - ones - total / (1.0 + np.exp(-f))
                in_grad = pull.T @ decoder.out[uniq].astype(np.float64)
                out_grad[uniq] += pull @ vectors
                out_weight[uniq] += total.sum(axis=1)
                for j, k in enumerate(ks):
                    rows.append((0, int(xs[r]), int(k) + 1, float(total[:, j].sum()), 0, lr * in_grad[j]))
            yield _round_rows(rows)
        touched = np.flatnonzero(out_weight)
        rows = [(1, int(n), 0, float(out_weight[n]), 0, lr * out_grad[n]) for n in touched]
        stats = np.array([ll_sum, float(ll_n), sense_sum, float(occurrences)])
        rows.append((3, 0, sense_max, 0.0, 0, stats))
        for at in range(0, len(rows), CHUNK):
            yield _round_rows(rows[at : at + CHUNK])

    return run


ROUND_ROWS = 1 << 16  # occurrences of a training round that are weighed together, beside all the sums that a task holds
MERGE_PAIRS = 1 << 18  # different rare pairs of a training round that a task holds before their gradients are added


class RoundSums:
    """Sums of a training round over occurrences in any order, held for all words of the model.

    Weights of pairs among the first ids are kept in a table whose gradients are taken once per task; those of other pairs are
    merged, and their gradients are taken when many have come together.
    """

    def __init__(self, words: Words, n_senses: np.ndarray, lr: float, threshold: float):
        self.words, self.n_senses, self.lr, self.threshold = words, n_senses, lr, threshold
        size, senses, dim = words.vecs.shape
        nodes = words.out.shape[1]
        self.posterior, self.n = np.zeros((size, senses)), np.zeros(size, np.int64)
        self.in_grad, self.in_weight = np.zeros((size, senses, dim)), np.zeros((size, senses))
        self.out_grad, self.out_weight = np.zeros((nodes, dim)), np.zeros(nodes)
        self.met = np.zeros(size, bool)  # words with a partner that has a path
        self.table: np.ndarray | None = None
        self.rare: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.stats, self.most = np.zeros(4), 0

    def add(self, batch: pa.RecordBatch) -> None:
        words = self.words
        x = batch.column("x").to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array(words.known(x)))
        x = batch.column("x").to_numpy().astype(np.int64)
        if not len(x):
            return
        offsets, ctx = lists_of(batch.column("ctx"))
        length, y = np.diff(offsets), ctx.to_numpy().astype(np.int64)
        has, of = length > 0, np.repeat(x, length)
        z = words.base[x]
        ll = words.loglik(of, y)
        if has.any():
            z[has] += np.add.reduceat(ll, offsets[:-1][has], axis=0)
        with np.errstate(invalid="ignore"):
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
        late = np.ones(len(x))
        if batch.schema.get_field_index("behind") >= 0:
            late = (1.0 - self.lr) ** batch.column("behind").to_numpy().astype(np.float64)
        self.posterior += sum_by(x, z * late[:, None], words.size)
        self.n += np.bincount(x, minlength=words.size)
        weight = np.repeat(np.where(z >= self.threshold, z, 0.0), length, axis=0)
        self.stats += [float((weight * ll).sum()), float(len(y)), float(self.n_senses[x].sum()), float(len(x))]
        self.most = max(self.most, int(self.n_senses[x].max()))
        path = words.decoder.start[y + 1] > words.decoder.start[y]
        self.met[of[path]] = True
        self._weigh(of, y, weight)

    def _weigh(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        hot = self.words.hot
        near = (x < hot) & (y < hot)
        if near.any():
            if self.table is None:
                self.table = np.zeros((weight.shape[1], hot * hot))
            cell, sums = merged_weights(x[near] * hot + y[near], weight[near])
            for k in range(weight.shape[1]):
                self.table[k, cell] += sums[:, k]
        if not near.all():
            self.rare.append(merged_weights(x[~near] << 32 | y[~near], weight[~near]))
            if sum(len(codes) for codes, _ in self.rare) >= 2 * MERGE_PAIRS:
                self._merge()

    def _merge(self, last: bool = False) -> None:
        if not self.rare:
            return
        codes, weight = merged_weights(np.concatenate([c for c, _ in self.rare]), np.concatenate([w for _, w in self.rare]))
        self.rare = [(codes, weight)]
        if last or len(codes) >= MERGE_PAIRS:
            self.rare = []
            self._pull(codes >> 32, codes & 0xFFFFFFFF, weight)

    def _pull(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Gradients of different pairs, sorted by ``x``."""
        words, decoder = self.words, self.words.decoder
        first, last = decoder.start[y], decoder.start[y + 1]
        for at in range(0, len(x), CHUNK):
            length = (last - first)[at : at + CHUNK]
            order = np.argsort(-length, kind="stable")
            begin, ordered = first[at : at + CHUNK][order], length[order]
            vec = np.ascontiguousarray(words.vecs[x[at : at + CHUNK][order]].astype(np.float64).transpose(2, 1, 0))
            w = np.ascontiguousarray(weight[at : at + CHUNK][order].T)
            grad = np.zeros(vec.shape)
            for step in range(int(ordered[0]) if len(ordered) else 0):
                n = int(np.searchsorted(-ordered, -step, side="left"))  # paths longer than ``step``
                node = decoder.node[begin[:n] + step]
                cell = words.out[:, node]
                f = vec[0, :, :n] * cell[0]
                for d in range(1, len(cell)):
                    f += vec[d, :, :n] * cell[d]
                pull = w[:, :n] * (1.0 - decoder.code[begin[:n] + step] - logistic(f))
                away = np.empty(cell.shape)
                for d in range(len(cell)):
                    grad[d, :, :n] += pull * cell[d]
                    away[d] = (pull * vec[d, :, :n]).sum(axis=0)
                self.pending.append((node, np.concatenate([away, w[:, :n].sum(axis=0)[None]])))
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            mine, starts = np.unique(x[at : at + CHUNK], return_index=True)
            self.in_grad[mine] += np.add.reduceat(grad[:, :, back], starts, axis=2).transpose(2, 1, 0)
            self.in_weight[mine] += np.add.reduceat(weight[at : at + CHUNK] * length[:, None], starts, axis=0)
            if sum(len(node) for node, _ in self.pending) >= max(1 << 18, len(self.out_weight)):
                self._nodes()
        self._nodes()

    def _nodes(self) -> None:
        """Add what came for the nodes."""
        if not self.pending:
            return
        node = np.concatenate([n for n, _ in self.pending])
        away = np.concatenate([a for _, a in self.pending], axis=1)
        self.pending = []
        for d in range(self.out_grad.shape[1]):
            self.out_grad[:, d] += np.bincount(node, away[d], len(self.out_weight))
        self.out_weight += np.bincount(node, away[-1], len(self.out_weight))

    def _pull_table(self) -> None:
        """Gradients of all pairs among the first ids: weights are added up along the tree, from the words to its root."""
        if self.table is None:
            return
        words, hot = self.words, self.words.hot
        node, code, begin, length = words.decoder.paths(np.arange(hot))
        if not len(node):
            return
        inner, row = np.unique(node, return_inverse=True)
        step = np.arange(len(node)) - np.repeat(begin, length)
        child = np.where(step == 0, len(inner) + np.repeat(np.arange(hot), length), np.roll(row, 1))
        height = np.repeat(length, length) - step  # from the root
        edges = np.unique(np.stack([-height, row, code.astype(np.int64), child]), axis=1)
        levels = np.split(edges, np.flatnonzero(np.diff(edges[0])) + 1, axis=1)
        out = words.out.T[inner]
        weights = self.table.reshape(-1, hot, hot)
        used = np.flatnonzero(weights.any(axis=(0, 2)))
        for at in range(0, len(used), 128):
            x = used[at : at + 128]
            vec = words.vecs[x].astype(np.float64)
            total = np.zeros((len(inner) + hot, len(x) * words.senses))
            total[len(inner) :] = weights[:, x].transpose(2, 1, 0).reshape(hot, -1)
            ones = np.zeros((len(inner), total.shape[1]))
            for level in levels:
                for one in (0, 1):
                    _, to, _, below = level[:, level[2] == one]
                    total[to] += total[below]
                    if one:
                        ones[to] = total[below]
            total = total[: len(inner)]
            vectors = vec.reshape(-1, vec.shape[2])
            pull = total - ones - total * logistic(out @ vectors.T)
            self.in_grad[x] += (pull.T @ out).reshape(vec.shape)
            self.in_weight[x] += total.sum(axis=0).reshape(len(x), -1)
            self.out_grad[inner] += pull @ vectors
            self.out_weight[inner] += total.sum(axis=1)
        self.table = None

    def results(self):
        """Batches of ``(kind, id, sense, weight, n, vec)``, as :func:`round_scorer` has them."""
        self._merge(last=True)
        self._pull_table()
        words = self.words
        read = np.flatnonzero(self.n)
        yield from _sum_batches(2, read, 0, 0.0, self.n[read], self.posterior[read])
        x, k = np.nonzero(self.met[:, None] & ~np.isneginf(words.base))
        yield from _sum_batches(0, x, k + 1, self.in_weight[x, k], 0, self.lr * self.in_grad[x, k])
        node = np.flatnonzero(self.out_weight)
        yield from _sum_batches(1, node, 0, self.out_weight[node], 0, self.lr * self.out_grad[node])
        yield _round_rows([(3, 0, self.most, 0.0, 0, self.stats)])


def logistic(f: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-f))


def merged_weights(codes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in ascending order, and the summed weights of each."""
    found, place = np.unique(codes, return_inverse=True)
    return found, sum_by(place, weight, len(found))


def _sum_batches(kind: int, ids, sense, weight, n, vec: np.ndarray):
    for at in range(0, len(ids), CHUNK):
        cut = slice(at, at + CHUNK)
        size = len(ids[cut])
        column = lambda v, t: pa.array(np.broadcast_to(v[cut] if np.ndim(v) else v, size).astype(t))
        columns = [column(kind, np.int32), column(ids, np.int32), column(sense, np.int32), column(weight, np.float64), column(n, np.int64)]
        yield pa.RecordBatch.from_arrays([*columns, list_column(vec[cut], vec.shape[1])], names=["kind", "id", "sense", "weight", "n", "vec"])


def row_round_scorer(shared, side, lr: float, threshold: float):
    """:func:`round_scorer` over occurrences ``(x, ctx)``, and ``behind`` where they have it, in any order."""

    def run(batches):
        sums = RoundSums(words_of(shared, side), side.value[3], lr, threshold)
        for batch in gathered(batches, ROUND_ROWS):
            sums.add(batch)
        yield from sums.results()

    return run


def _round_rows(rows) -> pa.RecordBatch:
    names = ["kind", "id", "sense", "weight", "n", "vec"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def chunk_packer(lists: list[str]):
    """Kernel over tokens; those of a chunk that stand together with growing ``pos`` become one row of lists.

    ``shift`` is the position less the place in the list: it changes only where words were dropped, so it packs well.
    """

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh, number = np.ones(n, dtype=bool), np.arange(n)
            fresh[1:] = False
            for name in ("doc_id", "chunk_id"):
                column = batch.column(name)
                gone = column.is_null().to_numpy(zero_copy_only=False)
                value = column.fill_null(0).to_numpy(zero_copy_only=False)
                fresh[1:] |= (value[1:] != value[:-1]) | (gone[1:] != gone[:-1])
            pos = batch.column("pos").to_numpy(zero_copy_only=False)
            fresh[1:] |= pos[1:] <= pos[:-1]
            first = np.flatnonzero(fresh)
            offsets = pa.array(np.append(first, n).astype(np.int32))
            shift = (pos - (number - np.maximum.accumulate(np.where(fresh, number, 0)))).astype(np.int32)
            columns = [batch.column(name).take(pa.array(first)) for name in ("doc_id", "chunk_id")]
            columns += [pa.ListArray.from_arrays(offsets, values) for values in [pa.array(shift), *map(batch.column, lists)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chunk_id", "shift", *lists])

    return run


def run_heads(limit: int):
    """Kernel that keeps the first ``limit`` rows of each run of rows with one ``run`` and growing ``i``, without ``run``."""

    def run(batches):
        for batch in batches:
            of, i = batch.column("run").to_numpy(), batch.column("i").to_numpy()
            number = np.arange(len(of))
            fresh = np.ones(len(of), dtype=bool)
            fresh[1:] = (of[1:] != of[:-1]) | (i[1:] <= i[:-1])
            begin = np.maximum.accumulate(np.where(fresh, number, 0)) if len(of) else number
            head = batch.filter(pa.array(number - begin < limit))
            yield head.select([name for name in head.schema.names if name != "run"])

    return run


def _best_of(rows: np.ndarray, value: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Positions of the ``k`` largest values of each row, ties by ``order`` (the last key counts most), best first."""
    at = np.lexsort((*order, -value, rows))
    rows = rows[at]
    return at[np.arange(len(at)) - np.searchsorted(rows, rows) < k]


def top_k_scorer(k: int):
    """Kernel over pairs of blocks: candidate matrix against query matrix, the best ``k`` per query.

    As long as the ``query_block`` stays the same, the best so far are kept, and later candidates only count if they reach a query's last one.
    """

    def matrix(cell):
        values = cell.values
        offsets, flat = lists_of(values.field("vec"))
        vecs = flat.to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)
        return values.field("word_id").to_numpy(), values.field("sense").to_numpy(), vecs

    def candidates(cell):
        ids, senses, vecs = matrix(cell)
        return ids, senses, vecs / np.linalg.norm(vecs, axis=1, keepdims=True)

    def out(queries, best):
        row, value, ids, senses = best
        columns = [queries[0][row], queries[1][row], ids, senses, value]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query_sense", "word_id", "sense", "sim"])

    def merged(queries, floor, best, ids, senses, cand):
        parts = [best]
        for first in range(0, len(floor), QUERIES_AT_ONCE):
            part = slice(first, first + QUERIES_AT_ONCE)
            sim = queries[2][part] @ cand.T
            least = floor[part]
            if np.isneginf(least).any() and len(ids) > k:
                own = (queries[0][part, None] == ids[None, :]) & (queries[1][part, None] == senses[None, :])
                ranked = np.partition(np.where(own | ~np.isfinite(sim), -np.inf, sim), len(ids) - k, axis=1)
                least = np.maximum(least, ranked[:, len(ids) - k])
            row, at = np.nonzero(sim >= least[:, None])
            value = sim[row, at]
            row += first
            ok = np.isfinite(value) & ((queries[0][row] != ids[at]) | (queries[1][row] != senses[at]))
            row, at, value = row[ok], at[ok], value[ok]
            parts.append((row, value, ids[at], senses[at]))
        row, value, ids, senses = (np.concatenate(x) for x in zip(*parts, strict=True))
        now = _best_of(row, value, (senses, ids), k)
        row, value = row[now], value[now]
        full = np.bincount(row, minlength=len(floor)) == k
        last = np.append(row[1:] != row[:-1], True)[: len(row)]
        floor[full] = value[last & full[row]]
        return row, value, ids[now], senses[now]

    def run(batches):
        block = queries = floor = best = None
        for batch in batches:
            for r in range(batch.num_rows):
                if queries is None or batch.column("query_block")[r].as_py() != block:
                    if queries is not None:
                        yield out(queries, best)
                    block, queries = batch.column("query_block")[r].as_py(), matrix(batch.column("queries")[r])
                    floor = np.full(len(queries[0]), -np.inf)
                    best = (np.zeros(0, np.int64), np.zeros(0), queries[0][:0], queries[1][:0])
                best = merged(queries, floor, best, *candidates(batch.column("candidates")[r]))
        if queries is not None:
            yield out(queries, best)

    return run
