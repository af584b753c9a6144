"""Exact top-k by integer inner product: dual-tree search over cover trees.

Vectors are quantised, component x to floor(scale * x). The upper level of the candidates' tree is global: ``cells`` around
centres that a farthest-first cover of a bounded sample gives; every row is in the cell of its nearest centre, and a cell
has the covering radius of all its rows. A cell can hold no row better for a query q than <q, c> + |q| R. Each query first
visits its ``probe`` most promising cells, which gives it a k-th score, and then only those cells whose bound reaches it:
no other cell's rows are ever compared with it. Within a cell, a cover tree is built over the queries that came and one
over the rows, and both are descended at once: a pair of nodes can score at most <q, r> + |q| R_r + |r| R_q + R_q R_r
(centres q, r; covering radii R); it is pruned when that is below the worst k-th score of the query group. Leaves are
compared as integer matrix products. A tree node is centred on a row of its own, its children cover it within its radius
/ base and are further apart than that; a node that would need too many children for it (data without clusters) is a leaf.

Of equal vectors only the k + 1 smallest ids can be in an answer; the others are left out before any row is copied, with a
limit that is applied before the shuffle, so groups of copies cost nothing.

Scale: candidate rows go to their cell once a round, whatever the number of queries; queries go to the cells that their
bound reaches. Cells and queries of a cell are cut into blocks, so a task holds ``query_block`` + ``candidate_block``
vectors. What is broadcast are the centres, at most ``max_cells`` a vector length and ``centre_bytes`` in all, and a row
a cell. On data without clusters no bound prunes: each query then meets every block once, as an exact answer asks for.

Edge cases: vectors null, empty, or with a null or non-finite component take no part, nor do rows without an id. Ties
go to the smaller id. Candidates with the query's id are its own row and left out. Equal (id, vector) queries are
answered once; repeated candidate rows each count. Vectors of another length are no candidates. A query with fewer
than k candidates gets all. Scores beyond 64 bits are held at the limit. Empty tables give no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenscan.llm._common import dropped, written


@dataclass(frozen=True)
class TopKOptions:
    k: int = 5
    scale: float = 256.0
    query_block: int = 4_096
    candidate_block: int = 16_384
    #: Rows a cell is meant to have; the most cells and bytes of centres; rows among which centres are chosen.
    cell_rows: int = 8_192
    max_cells: int = 1_024
    centre_bytes: int = 32 << 20
    sample: int = 16_384
    #: Cells a query visits before bounds are judged.
    probe: int = 2
    leaf: int = 8
    #: Covering radii shrink by this factor from a level to the next.
    base: float = 3.0


class _Node:
    __slots__ = ("centre", "radius", "norm", "rows", "children")

    def __init__(self, at: int, rows: np.ndarray, x: np.ndarray):
        self.centre, self.rows = x[at], rows
        self.radius = float(np.sqrt(((x[rows] - self.centre) ** 2).sum(1).max()))
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.children: list[_Node] = []


def cover(x: np.ndarray, first: int, apart: float, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Centres (rows of x, from first on, each further than apart from those before), the nearest one of every row, and whether all rows are within apart; most centres at most."""
    centres, squares = [first], (x**2).sum(1)
    away = lambda i: squares - 2 * (x @ x[i]) + squares[i]
    owner, nearest = np.zeros(len(x), np.int64), away(first)
    while len(centres) < most and nearest.max(initial=0) > apart * apart:
        far = int(nearest.argmax())
        d = away(far)
        closer = d < nearest
        owner[closer] = len(centres)
        nearest = np.minimum(nearest, d)
        centres.append(far)
    return np.array(centres), owner, bool(nearest.max(initial=0) <= apart * apart)


def cover_tree(x: np.ndarray, leaf: int, base: float, most: int = 1024) -> _Node:
    """The tree over the rows of x (one at least). A node that would need more children than most, or than half of its rows, is a leaf (most 0: any number will do)."""
    root = _Node(int(((x - x.mean(0)) ** 2).sum(1).argmin()), np.arange(len(x)), x)
    open_nodes = [(root, int(((x - x.mean(0)) ** 2).sum(1).argmin()))]
    while open_nodes:
        node, at = open_nodes.pop()
        rows = node.rows
        if len(rows) <= leaf or node.radius == 0 or not np.isfinite(node.radius):
            continue
        centres, owner, covered = cover(x[rows], int(np.searchsorted(rows, at)), node.radius / base, min(max(8, len(rows) // 2), most) if most else len(rows))
        if covered:
            for c, own in enumerate(rows[centres]):
                child = _Node(int(own), rows[owner == c], x)
                node.children.append(child)
                open_nodes.append((child, int(own)))
    return root


class _Best:
    """The k best of every query so far: scores and ids, ties to smaller ids. floor: scores below it are known not to matter."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((n, k), np.iinfo(np.int64).min, dtype=np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.k, self.compared = k, 0
        self.floor = np.full(n, np.iinfo(np.int64).min, np.int64) if floor is None else floor

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        self.compared += scores.size
        worst = self.worst(rows)
        valid = valid & (scores >= worst[:, None])
        some = valid.any(1)
        if not some.any():
            return
        rows, scores, valid = rows[some], scores[some], valid[some]
        s = np.concatenate([self.score[rows], np.where(valid, scores, np.iinfo(np.int64).min)], 1)
        i = np.concatenate([self.id[rows], np.where(valid, np.broadcast_to(ids, scores.shape), np.iinfo(np.int64).max)], 1)
        if s.shape[1] > 8 * self.k:  # only the k best scores, with all ties of the last, need sorting
            good = s >= np.partition(s, -self.k, axis=1)[:, -self.k, None]
            top = np.argsort(~good, axis=1, kind="stable")[:, : int(good.sum(1).max())]
            s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (a @ b.T).astype(np.int64)  # whole numbers below 2**53
    limit = np.iinfo(np.int64)
    p = np.array([[int(v) for v in r] for r in a], dtype=object) @ np.array([[int(v) for v in r] for r in b], dtype=object).T
    return np.array([[min(max(v, limit.min), limit.max) for v in r] for r in p], dtype=np.int64).reshape(len(a), len(b))


def dual_tree(q: np.ndarray, q_id: np.ndarray, r: np.ndarray, r_id: np.ndarray, o: TopKOptions, floor: np.ndarray | None = None) -> _Best:
    """The best k rows of r for every row of q, but for those that score below its floor."""
    best = _Best(len(q), o.k, floor)
    if not len(q) or not len(r):
        return best
    size = np.sqrt((q**2).sum(1).max() * (r**2).sum(1).max())
    exact, slack = bool(size < 2**52), 1e-9 * (1 + size)

    def bound(a: _Node, b: _Node) -> float:
        return float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius + slack

    # the pair of the greatest bound comes first: a group meets what is likely best for it before the rest
    turn, whole = itertools.count(), cover_tree(r, o.leaf, o.base)
    # queries are split down to single ones if need be, but only if there are clusters of rows to keep them from
    heap = [(-np.inf, next(turn), cover_tree(q, 1 if whole.children else len(q), o.base, 0), whole)]
    while heap:
        most, _, a, b = heapq.heappop(heap)
        worst = float(best.worst(a.rows).min())
        if -most < worst:
            continue
        if not a.children and not b.children:
            for i in range(0, len(a.rows), 512):
                asked = a.rows[i : i + 512]
                for j in range(0, len(b.rows), 4096):
                    rows = b.rows[j : j + 4096]
                    best.add(asked, _products(q[asked], r[rows], exact), r_id[rows], r_id[rows][None, :] != q_id[asked][:, None])
            continue
        split_b = b.children and (not a.children or b.radius >= a.radius)
        for x, y in ((a, c) for c in b.children) if split_b else ((c, b) for c in a.children):
            if not (most := bound(x, y)) < worst:
                heapq.heappush(heap, (-most, next(turn), x, y))
    return best


def _floored(x) -> Column:
    """floor of x as a double, beyond 64 bits too; without a negative zero."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def quantised(vectors: DataFrame, o: TopKOptions, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v: floor(scale * x) of every component, of the rows that take part."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: _floored(x.cast("double") * o.scale)).alias("v"))


# cells


def _matrix(col: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return np.asarray(col.flatten()).astype(np.float64).reshape(len(col), -1)


def centres(rows: DataFrame, o: TopKOptions) -> dict[int, np.ndarray]:
    """By vector length: centres of cells, chosen by a farthest-first cover among at most o.sample rows."""
    counts = {r["length"]: r["count"] for r in rows.groupBy(F.size("v").alias("length")).count().collect()}  # one row a length
    sample = rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(o.sample).select("v", F.size("v").alias("length")).toArrow()
    out = {}
    for length, n in counts.items():
        own = sample.filter(pc.equal(sample.column("length"), length)).column("v").combine_chunks()
        most = min(max(1, -(-n // o.cell_rows)), o.max_cells, max(1, o.centre_bytes // (8 * length * len(counts))))
        x = _matrix(own) if len(own) else np.zeros((1, length))
        at, _, _ = cover(x, int(((x - x.mean(0)) ** 2).sum(1).argmin()), 0.0, most)
        out[length] = x[at]
    return out


def in_cells(rows: DataFrame, of: dict[int, np.ndarray]) -> DataFrame:
    """id, v, length, cell (of the nearest centre) and distance to the centre of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("length"))
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                x, c = _matrix(part.column("v")), shared.value[int(length)]
                cell = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
                distance = np.sqrt(((x - c[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], names=[*part.schema.names, "cell", "distance"])

    return rows.select("id", "v", F.size("v").alias("length")).mapInArrow(run, "id long, v array<double>, length int, cell int, distance double")


def _reached(asked: DataFrame, of: dict[int, np.ndarray], radii: dict[int, np.ndarray], o: TopKOptions, count: bool) -> DataFrame:
    """asked (id, query, v, length, floor, probed) by the cells each query is to visit, or, with count, only their number by length and cell.

    Not probed yet: the most promising cells; afterwards the others whose bound reaches the floor."""
    shared = asked.sparkSession.sparkContext.broadcast((of, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("length"))
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                q = _matrix(part.column("v"))
                c, radius = (x.get(int(length)) for x in shared.value)
                if c is None:
                    continue
                inner, norm = q @ c.T, np.sqrt((q**2).sum(1))[:, None]
                bound = inner + norm * radius + 1e-9 * (1 + norm * (np.sqrt((c**2).sum(1)) + radius))
                there = np.broadcast_to(radius >= 0, inner.shape)  # an empty cell has a negative radius
                first = np.argsort(np.where(there, -inner, np.inf), axis=1, kind="stable")[:, : o.probe]
                probed = np.zeros(inner.shape, bool)
                np.put_along_axis(probed, first, True, axis=1)
                floor = np.asarray(part.column("floor")).astype(np.float64)[:, None]
                done = np.asarray(part.column("probed"))[:, None]
                row, cell = np.nonzero(there & np.where(done, ~probed & ~(bound < floor), probed))
                if count:
                    n = np.bincount(cell, minlength=len(c))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), length, np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(n)], names=["length", "cell", "n"])
                else:
                    for i in range(0, len(row), 8192):
                        sent = part.take(pa.array(row[i : i + 8192]))
                        yield pa.RecordBatch.from_arrays([*(sent.column(x) for x in ("id", "query", "v", "length", "floor")), pa.array(cell[i : i + 8192].astype(np.int32))], names=["id", "query", "v", "length", "floor", "cell"])

    if count:
        return asked.mapInArrow(run, "length int, cell int, n long").groupBy("length", "cell").agg(F.sum("n").alias("n")).where("n > 0")
    return asked.mapInArrow(run, "id long, query long, v array<double>, length int, floor long, cell int")


def _visited(asked: DataFrame, rows: DataFrame, sizes: dict[tuple[int, int], int], of: dict, radii: dict, o: TopKOptions) -> DataFrame:
    """query_id, query, vec_id, score: the best k of each block that a query visits."""
    spark = asked.sparkSession
    want = [(r["length"], r["cell"], -(-sizes[r["length"], r["cell"]] // o.candidate_block), -(-r["n"] // o.query_block)) for r in _reached(asked, of, radii, o, True).collect()]  # a row a cell
    schema = "query_id long, query long, vec_id long, score long"
    if not want:
        return spark.createDataFrame([], schema)
    layout = F.broadcast(spark.createDataFrame(want, "length int, cell int, c_blocks int, q_blocks int"))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(9)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = _reached(asked, of, radii, o, False).join(layout, ["length", "cell"]).withColumn("bq", own("q_blocks")).withColumn("br", every("c_blocks"))
    right = rows.join(layout, ["length", "cell"]).withColumn("br", own("c_blocks")).withColumn("bq", every("q_blocks"))
    grid = ["length", "cell", "bq", "br"]

    def cell(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if len(q) and len(r):
            qv, rv = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (q, r))
            best = dual_tree(qv, q["id"].to_numpy(np.int64), rv, r["id"].to_numpy(np.int64), o, q["floor"].to_numpy(np.int64))
            found = best.id != np.iinfo(np.int64).max
            n = found.sum(1)
            out = {"query_id": np.repeat(q["id"].to_numpy(np.int64), n), "query": np.repeat(q["query"].to_numpy(np.int64), n), "vec_id": best.id[found], "score": best.score[found]}
        return pd.DataFrame(out).astype("int64")

    return left.select(*grid, "id", "query", "v", "floor").groupBy(*grid).cogroup(right.select(*grid, "id", "v").groupBy(*grid)).applyInPandas(cell, schema)


def top_k(vectors: DataFrame, queries: DataFrame, o: TopKOptions = TopKOptions(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of vectors for each row of queries."""
    smallest = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    some = written(quantised(vectors, o, key, vector).withColumn("n", smallest).where(F.col("n") <= o.k + 1).drop("n"), "vectors")
    of = centres(some, o)
    rows = written(in_cells(some, of), "cells")
    radii = {length: np.full(len(c), -1.0) for length, c in of.items()}
    sizes = {}
    for r in rows.groupBy("length", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect():  # a row a cell
        sizes[r["length"], r["cell"]] = r["n"]
        radii[r["length"]][r["cell"]] = r["radius"] * (1 + 1e-9)
    # two queries of one id and different vectors are told apart by a hash of the vector
    asked = quantised(queries, o, key, vector).dropDuplicates(["id", "v"]).select("id", F.xxhash64("v").alias("query"), "v", F.size("v").alias("length"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    ranked = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= o.k)
    least = F.lit(-(2**63))
    first = written(ranked(_visited(asked.select("*", least.alias("floor"), F.lit(False).alias("probed")), rows, sizes, of, radii, o)).drop("rank"), "probed")
    floors = first.groupBy(F.col("query_id").alias("id"), "query").agg(F.when(F.count("*") >= o.k, F.min("score")).alias("floor"))
    again = asked.join(floors, ["id", "query"], "left").select("id", "query", "v", "length", F.coalesce("floor", least).alias("floor"), F.lit(True).alias("probed"))
    dropped(some)
    return ranked(first.unionByName(_visited(written(again, "floors"), rows, sizes, of, radii, o))).select("query_id", "rank", "vec_id", "score")
