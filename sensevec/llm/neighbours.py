"""Embedding near-duplicates by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

THRESHOLD = 0.98
TREES = 8
SPILL = 0.03  # vectors this close to a split go to both sides
COPIES = 2  # leaves of a tree from which on a vector is not spilled any more
LEAF_ROWS = 512  # that a tree aims at
BLOCK_ROWS = 1024  # larger leaves are compared block by block
SAMPLE_ROWS = 20_000  # that the splits are fitted on
SEED = 17
MOST_DEPTH = 40


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; a vector that cannot be compared has none."""
    for batch in batches:
        ids, vectors, labels = (c.to_pylist() for c in batch.columns)
        units, digests = [], []
        for vector, label in zip(vectors, labels, strict=True):
            unit = None
            if label is not None and vector and None not in vector:
                values = np.asarray(vector, np.float64)
                largest = np.abs(values).max()
                if np.isfinite(largest) and largest > 0:
                    values = values / largest  # neither overflow nor underflow in the norm
                    unit = values / np.sqrt(values @ values)
            units.append(None if unit is None else unit.tolist())
            content = b"" if vector is None else np.array([np.nan if x is None else x for x in vector], np.float64).tobytes()
            digests.append(hashlib.md5(content).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(units, pa.list_(pa.float64())), pa.array(digests)],
            ["vec_id", "label", "unit", "digest"],
        )


class Forest:
    """Splits of each tree, level by level; the same splits serve every label.

    Node k of a level is split along a random direction at the median of the sample rows that reach it.
    """

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf_rows: int, spill: float, seed: int):
        self.spill, self.trees = spill, []
        depth = min(MOST_DEPTH, max(0, int(np.ceil(np.log2(max(rows, 1) / leaf_rows)))))
        draw = np.random.default_rng(seed)
        for _ in range(trees):
            levels, at = [], np.zeros(len(sample), np.int64)
            directions = draw.standard_normal((depth, sample.shape[1])) if len(sample) else np.zeros((0, 1))
            directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-300)
            for direction in directions:
                nodes, inverse = np.unique(at, return_inverse=True)
                value = sample @ direction
                cuts = pd.Series(value).groupby(inverse).median().to_numpy()
                levels.append((direction, nodes, cuts))
                at = at * 2 + (value >= cuts[inverse])
            self.trees.append(levels)

    def leaves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, tree, leaf)`` of every leaf that a row falls in.

        A row near a split goes on at both sides until it is in ``COPIES`` places of the tree, so the leaves of a row do not
        grow in number with the depth.
        """
        rows, trees, leaves = [], [], []
        for tree, levels in enumerate(self.trees):
            row, at = np.arange(len(units)), np.zeros(len(units), np.int64)
            for direction, nodes, cuts in levels:
                near = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                value = (units @ direction)[row] - cuts[near]
                spill = np.where(np.bincount(row, minlength=len(units))[row] < COPIES, self.spill, 0.0)
                right, left = value >= -spill, value < spill
                row = np.concatenate([row[left], row[right]])
                at = np.concatenate([at[left] * 2, at[right] * 2 + 1])
            rows.append(row)
            trees.append(np.full(len(row), tree))
            leaves.append(at)
        return np.concatenate(rows), np.concatenate(trees), np.concatenate(leaves)


def _compare(threshold: float):
    """Links of a pair of blocks of one leaf: their number per row, and each row's smallest linked one.

    A pair that shares several leaves is counted in the first of them, by the leaf codes that both rows carry.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        code, low, high = key[1], key[2], key[3]
        left, right = frame[frame.block == low], frame[frame.block == high]
        if left.empty or right.empty:
            return pd.DataFrame({"vec_id": [], "n": [], "other": []})
        a, b = np.stack(left.unit.to_numpy()), np.stack(right.unit.to_numpy())
        linked = a @ b.T >= threshold
        ids_a, ids_b = left.vec_id.to_numpy(), right.vec_id.to_numpy()
        if low == high:
            linked &= ids_a[:, None] != ids_b[None, :]
        if not linked.any():
            return pd.DataFrame({"vec_id": [], "n": [], "other": []})
        least_a = np.where(linked, ids_b[None, :], np.iinfo(np.int64).max).min(1)
        earlier_a = [x[: np.searchsorted(x, code)] for x in left.codes]
        earlier_b = [x[: np.searchsorted(x, code)] for x in right.codes]
        known = np.unique(np.concatenate([*earlier_a, *earlier_b, np.zeros(0, np.int64)]))
        if len(known):
            one, two = np.zeros((len(left), len(known)), np.float32), np.zeros((len(right), len(known)), np.float32)
            for matrix, earlier in ((one, earlier_a), (two, earlier_b)):
                for k, x in enumerate(earlier):
                    matrix[k, np.searchsorted(known, x)] = 1
            fresh = linked & (one @ two.T == 0)
        else:
            fresh = linked
        copies_a, copies_b = left.copies.to_numpy(), right.copies.to_numpy()
        out = [pd.DataFrame({"vec_id": ids_a, "n": fresh @ copies_b, "other": least_a})[linked.any(1)]]
        if low != high:
            least_b = np.where(linked, ids_a[:, None], np.iinfo(np.int64).max).min(0)
            out.append(pd.DataFrame({"vec_id": ids_b, "n": copies_a @ fresh, "other": least_b})[linked.any(0)])
            out.append(_pair_edges(linked, ids_a, ids_b))
        else:
            out.append(_forest_edges(linked, ids_a))
        return pd.concat(out)

    return run


def _forest_edges(linked: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """Edges that connect each connected set of a block to its smallest id."""
    root = ids.copy()
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
        if (least == root).all():
            break
        root = least
    return pd.DataFrame({"vec_id": ids, "n": 0, "other": root})[root != ids]


def _pair_edges(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> pd.DataFrame:
    """Edges that connect each connected set of two blocks to its smallest id; every row is searched from once."""
    left, right = linked.any(1), linked.any(0)
    nodes, roots = [], []
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        left[start] = False
        rows, members = np.array([start]), [ids_a[[start]]]
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(0) & right)
            right[columns] = False
            rows = np.flatnonzero(linked[:, columns].any(1) & left)
            left[rows] = False
            members += [ids_b[columns], ids_a[rows]]
        found = np.concatenate(members)
        nodes.append(found)
        roots.append(np.full(len(found), found.min(), found.dtype))
    edges = pd.DataFrame({"vec_id": np.concatenate(nodes), "n": 0, "other": np.concatenate(roots)})
    return edges[edges.vec_id != edges.other]


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    spill: float = SPILL,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``(vec_id, embedding, label)``.

    Vectors of one label, not null, are linked when their cosine in double precision reaches ``threshold``.  A null vector, one of zeros, or one
    with null or non-finite parts links with nothing; vectors of different lengths are never compared.  Rows that repeat id,
    label and vector come out once; a null id links with nothing and is kept.  Rows that share an id but not the vector are linked
    each, and an id may be of any type that sorts.

    Equal vectors of a label are one vector with a count.  The splits of the trees are fitted on a hash-drawn sample of about ``sample_rows``
    vectors and sent to all tasks; every vector is then put into its leaves, with those near a split on both sides while they are in fewer than
    ``COPIES`` leaves of a tree: a vector is in at most a few leaves of each tree, however deep it is.
    Within a leaf all pairs are compared as matrix products, a leaf of over 1,024 rows in pairs of blocks by different tasks, so
    no leaf is capped.  Counts and edges leave the tasks, never all pairs; the edges are united to components.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, label string, unit array<double>, digest string"
    made = materialize(rows.mapInArrow(_prepared, schema).dropDuplicates(["vec_id", "label", "digest"]), "vectors")
    good = made.filter("unit is not null and vec_id is not null")
    group = F.concat_ws(":", F.size("unit").cast("string"), F.col("label"))
    # equal vectors of a label are searched once, under a number of their own: rows that repeat an id may hold different vectors
    copies = good.groupBy("label", "digest").agg(F.min("vec_id").alias("owner"), F.count("*").alias("copies"))
    once = good.select("vec_id", "label", "digest", group.alias("group"), "unit").join(
        copies.withColumnRenamed("owner", "vec_id"), ["label", "digest", "vec_id"]
    )
    number = F.monotonically_increasing_id().alias("vec_id")
    unique = materialize(
        once.select(number, F.col("vec_id").alias("owner"), "label", "digest", "group", "unit", "copies"), "unique-vectors"
    )
    sizes = unique.groupBy("group").agg(F.count("*").alias("rows"), F.first(F.size("unit")).alias("dim"))
    summary = sizes.groupBy("dim").agg(F.sum("rows").alias("rows"), F.max("rows").alias("largest"))
    parts = []
    for dim, n, largest in summary.orderBy("dim").collect():  # one row per length of a vector
        same = unique.filter(F.size("unit") == dim).select("vec_id", "group", "unit", "copies")
        drawn = same.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample_rows / n))))
        sample = drawn.select("unit").toArrow()["unit"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        forest = spark.sparkContext.broadcast(Forest(sample, largest, trees, leaf_rows, spill, SEED))
        parts.append(_in_leaves(same, forest))
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    if found is None:
        links = spark.createDataFrame([], "vec_id bigint, n bigint, other bigint")
    else:
        links = _links(materialize(found, "leaves"), threshold)
    links = materialize(links, "vector-links")
    counts = links.groupBy(F.col("vec_id").alias("number")).agg(F.sum("n").alias("n"))
    roots = materialize(components(links.select(F.col("vec_id").alias("a"), F.col("other").alias("b")).distinct()), "vector-roots")
    owners = unique.select(F.col("vec_id").alias("number"), "owner", "label", "digest", "copies")
    least = owners.join(roots, F.col("number") == F.col("node")).groupBy("root").agg(F.min("owner").alias("least"))
    placed = roots.join(least, "root").select(F.col("node").alias("number"), "least")
    classes = owners.join(counts, "number", "left").join(placed, "number", "left")
    classes = classes.select(
        "label",
        "digest",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.coalesce("least", "owner").alias("component_id"),
    )
    linked = good.select("vec_id", "label", "digest").join(classes, ["label", "digest"]).drop("label", "digest")
    alone = made.filter("unit is null or vec_id is null")
    alone = alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _in_leaves(unique: DataFrame, forest) -> DataFrame:
    """``(vec_id, group, unit, copies, codes, code)``: a row per leaf; ``codes`` are all leaves of the vector in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column("unit").flatten().to_numpy().reshape(batch.num_rows, -1)
            row, tree, leaf = forest.value.leaves(units)
            codes = tree << MOST_DEPTH | leaf
            order = np.lexsort((codes, row))
            row, codes = row[order], codes[order]
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes))
            taken = pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(codes)], [*taken.schema.names, "code"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unique.schema.fields)
    return unique.mapInArrow(run, f"{fields}, codes array<bigint>, code bigint")


def _links(leaves: DataFrame, threshold: float) -> DataFrame:
    sizes = leaves.groupBy("group", "code").agg(F.count("*").alias("rows")).filter("rows > 1")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    placed = leaves.join(sizes, ["group", "code"]).withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("partner", each)
    placed = placed.select(
        "group",
        "code",
        F.least("block", "partner").alias("low"),
        F.greatest("block", "partner").alias("high"),
        "block",
        "vec_id",
        "unit",
        "copies",
        "codes",
    )
    return placed.groupBy("group", "code", "low", "high").applyInPandas(
        _compare(threshold), "vec_id bigint, n bigint, other bigint"
    )
