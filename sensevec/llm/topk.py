"""Exact top-k inner products by a Voronoi join: cells round pivots, bounds from their summaries, bounded groups solved locally."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
TOP = 5
PIVOTS = 256  # cells of a table, at most
GROUP_QUERIES = 1 << 16  # queries that a task holds
SLICE_ROWS = 1 << 20  # rows that a task reads for them
TILE_QUERIES, TILE_ROWS = 1024, 4096
LARGEST = 1 << 62  # larger components count as this
NO_ID = np.iinfo(np.int64).max
SLACK = 1e-9  # bounds are doubles: they err on the side of comparing


def _scaled(scale: int):
    """Integer components, a digest of them and their number; a vector that takes no part is left out."""

    def whole(x: float) -> int:
        numerator, denominator = x.as_integer_ratio()
        return max(-LARGEST, min(LARGEST, numerator * scale // denominator))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows, digests = [], [], []
            for k, vector in enumerate(batch.column(1)):
                if not vector.is_valid or vector.values.null_count:
                    continue
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(values).all():
                    continue
                if len(values) and np.abs(values).max() * scale >= 2.0**52:
                    parts = np.array([whole(x) for x in values.tolist()], np.int64)
                else:
                    parts = np.floor(values * scale).astype(np.int64)
                keep.append(k)
                rows.append(parts)
                digests.append(hashlib.md5(parts.tobytes()).hexdigest())
            taken = batch.column(0).take(pa.array(keep, pa.int64()))
            sizes = pa.array([len(x) for x in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([taken, pa.array(digests, pa.string()), sizes, _lists(rows)], ["vec_id", "key", "dim", "vec"])

    return run


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


@dataclass
class Pivots:
    """Cell centres, and what summaries of the cells say about a search."""

    centres: np.ndarray
    radius: np.ndarray | None = None  # of the queries of each cell
    floor: np.ndarray | None = None  # every query of the cell has that many rows with at least this score
    group: np.ndarray | None = None  # first group of the cell's queries, -1 if it has none
    parts: np.ndarray | None = None  # groups of the cell

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector, and its distance from the centre."""
        centres, values = self.centres.astype(np.float64), vectors.astype(np.float64)
        far = (centres**2).sum(1)[None, :] - 2.0 * values @ centres.T
        cell = far.argmin(1)
        return cell, np.linalg.norm(values - centres[cell], axis=1)

    def upper(self, vectors: np.ndarray) -> np.ndarray:
        """No query of a cell has a higher score with a vector than this: ``<c, v> + r |v|``."""
        values = vectors.astype(np.float64)
        sizes = np.linalg.norm(values, axis=1)[:, None]
        reach = sizes * (self.radius + np.linalg.norm(self.centres.astype(np.float64), axis=1))[None, :]
        upper = values @ self.centres.astype(np.float64).T + sizes * self.radius[None, :] + SLACK * reach + SLACK
        return np.clip(upper, -(2.0**63), 2.0**63)  # as scores are

    def bound(self, cells: list, queries: list, top: int, group_queries: int) -> None:
        """Score floors and groups, from the summaries ``(cell, nearest distances)`` and ``(cell, rows, radius)``."""
        centres = self.centres.astype(np.float64)
        sizes = np.linalg.norm(centres, axis=1)
        n = len(centres)
        self.radius, counts = np.zeros(n), np.zeros(n, np.int64)
        for row in queries:
            self.radius[row["cell"]], counts[row["cell"]] = row["radius"], row["rows"]
        self.floor = np.full(n, -np.inf)
        known = [(row["cell"], d) for row in cells for d in row["nearest"]]
        if len(known) >= top:
            at, distance = np.array([c for c, _ in known]), np.array([d for _, d in known])
            least = centres @ centres[at].T - self.radius[:, None] * sizes[at][None, :]
            least -= (sizes + self.radius)[:, None] * distance[None, :]
            least -= SLACK * (np.abs(least) + (sizes + self.radius)[:, None] * sizes[at][None, :]) + SLACK
            self.floor = np.clip(np.sort(least, axis=1)[:, -top], -(2.0**63), 2.0**63)
        self.group, self.parts = np.full(n, -1), np.zeros(n, np.int64)
        left = set(np.flatnonzero(counts).tolist())
        now, group, held = (min(left) if left else None), 0, 0
        while left:  # cells near each other share a group, as many as fit
            left.remove(now)
            parts = int(-(-counts[now] // group_queries))
            if held and (parts > 1 or held + counts[now] > group_queries):
                group, held = group + 1, 0
            self.group[now], self.parts[now] = group, parts
            if parts > 1:
                group, held = group + parts, 0
            else:
                held += int(counts[now])
            if left:
                rest = np.array(sorted(left))
                now = int(rest[np.linalg.norm(centres[rest] - centres[now], axis=1).argmin()])

    def groups(self) -> int:
        return int((self.group + self.parts).max(initial=0))

    def wanted(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, group)``: the groups with a query that may need the row."""
        cells = np.flatnonzero(self.parts)
        need = self.upper(vectors)[:, cells] >= self.floor[cells][None, :]
        rows, at = np.nonzero(need)
        first, parts = self.group[cells[at]], self.parts[cells[at]]
        rows = np.repeat(rows, parts)
        ends = np.cumsum(parts)
        groups = np.repeat(first, parts) + np.arange(len(rows)) - np.repeat(ends - parts, parts)
        both = np.unique(rows * np.int64(max(1, self.groups())) + groups)
        return both // max(1, self.groups()), both % max(1, self.groups())


def _with_cells(pivots, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = pivots.value.nearest(_matrix(batch.column("vec"), dim))
            columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "distance"])

    return run


def _routed(pivots, dim: int):
    """A row for each group that may need the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(first, TILE_ROWS)
                rows, groups = pivots.value.wanted(_matrix(part.column("vec"), dim))
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(groups, pa.int32())], [*part.schema.names, "group"])

    return run


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, by the narrowest arithmetic that holds them; beyond a long the nearest long counts."""
    if not len(queries) or not len(vectors):
        return np.zeros((len(queries), len(vectors)))
    most = np.linalg.norm(queries.astype(np.float64), axis=1).max() * np.linalg.norm(vectors.astype(np.float64), axis=1).max()
    for kind, exact in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if most < 0.999 * exact:
            return queries.astype(kind) @ vectors.astype(kind).T
    if most < 0.999 * 2.0**63:
        return queries @ vectors.T
    whole = queries.astype(object) @ vectors.T.astype(object)
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The highest scores so far of the queries of one group."""

    def __init__(self, keys: list, vectors: np.ndarray, cells: np.ndarray, top: int):
        order = np.argsort(cells, kind="stable")
        self.keys, self.vectors, self.top = [keys[k] for k in order], vectors[order], top
        self.cells, self.starts = np.unique(cells[order], return_index=True)
        self.score = np.full((len(order), top), np.iinfo(np.int64).min)
        self.owner = np.full((len(order), top), NO_ID)
        self.found = np.full((len(order), top), None, object)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, keys: np.ndarray, owners: np.ndarray, vectors: np.ndarray, pivots: Pivots) -> None:
        """Only queries of cells that the bounds leave open are compared."""
        upper = pivots.upper(vectors)[:, self.cells].max(0)
        least = np.minimum.reduceat(self.least(), self.starts).astype(np.float64)
        need = upper >= least - np.abs(least) * SLACK
        ends = np.append(self.starts[1:], len(self.vectors))
        rows = np.concatenate([np.arange(a, b) for a, b, x in zip(self.starts, ends, need, strict=True) if x] or [np.zeros(0, np.int64)])
        for first in range(0, len(rows), TILE_QUERIES):
            self._merge(rows[first : first + TILE_QUERIES], keys, owners, vectors)

    def _merge(self, rows: np.ndarray, keys: np.ndarray, owners: np.ndarray, vectors: np.ndarray) -> None:
        scores = products(self.vectors[rows], vectors)
        least = self.least()[rows]
        if scores.shape[1] > self.top and (least == np.iinfo(np.int64).min).any():
            own = np.partition(scores, -self.top, axis=1)[:, -self.top]
            open_ = scores >= np.maximum(own, least.astype(scores.dtype))[:, None]
        else:
            open_ = scores >= least.astype(scores.dtype)[:, None]
        at, column = np.nonzero(open_)
        if not len(at):
            return
        touched = np.unique(at)
        old = np.repeat(touched, self.top)
        query = np.concatenate([old, at])
        score = np.concatenate([self.score[rows[touched]].ravel(), scores[at, column].astype(np.int64)])
        owner = np.concatenate([self.owner[rows[touched]].ravel(), owners[column]])
        found = np.concatenate([self.found[rows[touched]].ravel(), keys[column]])
        empty = np.array([x is None for x in found])
        order = np.lexsort((owner, empty, ~score, query))  # ~x falls as x grows, and every long has one
        begin = np.searchsorted(query[order], touched)
        first = (begin[:, None] + np.arange(self.top)[None, :]).ravel()
        best = order[first]
        where = rows[touched]
        for name, values in (("score", score), ("owner", owner), ("found", found)):
            getattr(self, name)[where] = values[best].reshape(len(touched), self.top)

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(np.not_equal(self.found, None))
        columns = [
            pa.array([self.keys[k] for k in query], pa.string()),
            pa.array(self.found[query, place], pa.string()),
            pa.array(self.owner[query, place], pa.int64()),
            pa.array(self.score[query, place], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["query_key", "key", "owner", "score"])


def _solved(pivots, dim: int, top: int):
    """Rows come by (group, slice), queries first; only the best of a slice leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, waiting = None, None, []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("group", "slice", "kind")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
                if a == b:
                    continue
                part, (group, number, kind) = batch.slice(a, b - a), marks[:, a]
                if at != (group, number):
                    if best is not None:
                        yield best.rows()
                    at, best, waiting = (group, number), None, []
                if kind == 0:
                    waiting.append(part)
                    continue
                if best is None and waiting:
                    held = pa.Table.from_batches(waiting).combine_chunks()
                    vectors = _matrix(held["vec"].combine_chunks(), dim)
                    best, waiting = Best(held["key"].to_pylist(), vectors, held["cell"].to_numpy(), top), []
                for first in range(0, part.num_rows if best is not None else 0, TILE_ROWS):
                    tile = part.slice(first, TILE_ROWS)
                    keys = np.array(tile.column("key").to_pylist(), object)
                    best.add(keys, tile.column("owner").to_numpy(), _matrix(tile.column("vec"), dim), pivots.value)
        if best is not None:
            yield best.rows()

    return run


def _of_length(unique: DataFrame, queries: DataFrame, dim: int, top: int, pivots: int, group_queries: int) -> DataFrame:
    """``(query_key, key, owner, score)``: the best vectors of every slice of rows for every query vector of one length."""
    spark = unique.sparkSession
    # centres are a hash-drawn bounded sample of the rows; any would do, the bounds hold for all
    drawn = unique.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(pivots)
    centres = _matrix(drawn.select("vec").toArrow()["vec"].combine_chunks(), dim)
    schema = "key string, owner bigint, vec array<bigint>, asked boolean, cell int, distance double"
    asked = unique.join(queries.select("key", F.lit(True).alias("asked")), "key", "left")
    rows = asked.select("key", "owner", "vec", F.coalesce("asked", F.lit(False)).alias("asked"))
    shared = spark.sparkContext.broadcast(Pivots(centres))
    placed = materialize(rows.mapInArrow(_with_cells(shared, dim), schema), "cells")
    # the summaries: per cell the distances of the nearest rows, and number and reach of its queries
    near = W.partitionBy("cell").orderBy("distance", "key")
    nearest = placed.select("cell", "distance", "key").withColumn("n", F.row_number().over(near)).filter(F.col("n") <= top)
    cells = nearest.groupBy("cell").agg(F.collect_list("distance").alias("nearest")).collect()
    reach = placed.filter("asked").groupBy("cell").agg(F.count("*").alias("rows"), F.max("distance").alias("radius")).collect()
    bounds = Pivots(centres)
    bounds.bound(cells, reach, top, group_queries)
    shared = spark.sparkContext.broadcast(bounds)
    groups = max(1, bounds.groups())
    wanted = -(-2 * spark.sparkContext.defaultParallelism // groups)
    slices = max(1, wanted, -(-placed.count() // SLICE_ROWS))
    firsts = spark.createDataFrame(
        [(int(c), int(bounds.group[c]), int(bounds.parts[c])) for c in np.flatnonzero(bounds.parts)], "cell int, first int, parts int"
    )
    columns = ["group", "slice", "kind", "key", "owner", "vec", "cell"]
    spread = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    part = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int").alias("group")
    asked = placed.filter("asked").join(F.broadcast(firsts), "cell")  # as many rows as pivots
    asked = asked.select(part, F.lit(0).alias("kind"), "key", "owner", "vec", "cell", spread).select(*columns)
    data = placed.select("key", "owner", "vec", "cell").mapInArrow(
        _routed(shared, dim), "key string, owner bigint, vec array<bigint>, cell int, group int"
    )
    data = data.withColumn("kind", F.lit(1)).withColumn("slice", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(slices)).cast("int"))
    both = asked.unionByName(data.select(*columns)).repartition(groups * slices, "group", "slice")
    both = both.sortWithinPartitions("group", "slice", "kind", "cell")
    return both.mapInArrow(_solved(shared, dim, top), "query_key string, key string, owner bigint, score bigint")


def search(
    vectors: DataFrame,
    asked: Column,
    top: int = TOP,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``asked`` holds the ``top`` other rows with the highest scores.

    Components become ``floor(scale * x)`` of the double, and the score is their exact inner product; ties go to the smaller ``vec_id``, a null
    one last.  Vectors that are null or hold null or non-finite components take no part; a vector meets only those of its own
    length, those without components score 0.  ``vec_id`` is an integer.  Components beyond ``2**62`` and scores beyond a long count as the nearest value that fits.
    Every row is a query or a candidate by itself: rows that repeat an id, or id and vector, are found and answered each.

    Equal vectors are searched once, with their ``top + 1`` smallest ids, which are all that an answer can need.  Vectors and queries fall
    into the cells of pivots.  From each cell's summary (its nearest rows, the reach of its queries) follows a score that all
    queries of a cell are sure to reach, and a row is sent only to groups of cells where it may reach that score.  A
    group holds at most ``group_queries`` queries; its rows are dealt to slices, whose tasks hold the queries and stream the rows.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>"), asked.alias("asked"))
    made = rows.select(F.struct("vec_id", "asked").alias("row"), "embedding")
    schema = f"vec_id struct<vec_id: {id_type}, asked: boolean>, key string, dim int, vec array<bigint>"
    made = made.mapInArrow(_scaled(scale), schema).select("vec_id.vec_id", "vec_id.asked", "key", "dim", "vec")
    made = materialize(made.withColumn("row", F.monotonically_increasing_id()), "scaled")
    by_id = W.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    ids = made.select("key", "vec_id", "row").withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= top + 1)
    ids = materialize(ids, "ids")
    owner = ids.filter("n = 1").select("row", F.coalesce(F.col("vec_id").cast("bigint"), F.lit(int(NO_ID))).alias("owner"))
    unique = materialize(made.select("row", "key", "dim", "vec").join(owner, "row").drop("row"), "distinct")
    queries = materialize(made.filter("asked").select("row", "vec_id", "key", "dim"), "queries")
    wanted = queries.groupBy("key", "dim").agg(F.count("*").alias("n"))
    found = None
    for (dim,) in wanted.select("dim").distinct().orderBy("dim").collect():  # one row per length of a vector
        of = F.col("dim") == dim
        part = _of_length(unique.filter(of).drop("dim"), wanted.filter(of), dim, top + 1, pivots, group_queries)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score bigint")
    order = [F.col("score").desc(), F.col("owner")]
    found = materialize(found, "found")
    best = found.withColumn("n", F.row_number().over(W.partitionBy("query_key").orderBy(*order))).filter(F.col("n") <= top + 1)
    best = best.select("query_key", "key", "score")
    named = best.join(ids.select("key", "vec_id", F.col("row").alias("other")), "key")
    again = named.groupBy("query_key").agg(F.collect_list(F.struct("score", "vec_id", "other")).alias("best"))  # (top + 1)^2 at most
    answers = queries.join(again, queries["key"] == again["query_key"]).select(
        queries["vec_id"].alias("query_id"), F.col("row"), F.filter("best", lambda b: b["other"] != F.col("row")).alias("best")
    )
    ordered = F.array_sort(
        F.transform(
            "best",
            lambda b: F.struct(F.bitwise_not(b["score"]).alias("down"), b["vec_id"].isNull().alias("none"), b["vec_id"].alias("id"), b["score"].alias("score")),
        )
    )
    listed = answers.select("query_id", F.posexplode(F.slice(ordered, 1, top)).alias("at", "hit"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def oracle(top: int = TOP, scale: int = SCALE, every: int = 50) -> str:
    """The same rows in DuckDB's SQL: all scores of each query, sorted."""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= {top}"""
