"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are turned to integers. Every vector goes to the cell of its nearest pivot; each cell is summed up
by its size, its radius and the distances of its vectors nearest to the pivot. For a query q and a vector x
of a cell with pivot p, the score q.x lies within |q| |x - p| of q.p. Queries are grouped by their nearest
pivots too, and a group is summed up by its size, its radius and its longest query, so the summaries give each
group a score that k vectors are certain to reach for all its queries. A cell's vectors are sent only to the
groups for which the cell's best possible score reaches that; groups of neighbouring pivots share a block of
queries, and large ones are cut. Inside a group each query goes, by its own bound, only to the cells it needs.
Cells are cut into buckets of a fixed size, and each bucket is searched locally with numpy. Pivots and
summaries are bounded in number whatever the table holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import bounded_batches, partitions, read_table, stored


@dataclass(frozen=True)
class Settings:
    k: int = 5
    scale: int = 256
    #: pivots are about the square root of the number of vectors, at most so many
    most_pivots: int = 1024
    #: queries of one block, which is one group of queries, several of neighbouring pivots or a part of a large one
    block: int = 16384
    #: vectors of one bucket on average, however many vectors a cell has
    bucket: int = 4096


def whole_numbers(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v``: floor(scale * x) of each component, as a little-endian int64 binary.

    Rows whose id or vector is null, and vectors with a null or non-finite component, take no part; an empty vector scores
    0 with everything. Vectors of unequal lengths are filled up with zeros when they meet. Scores must fit into a long.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(v, "<i8").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "v"])

    return rows.mapInArrow(run, "id long, v binary")


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """Rows of packed int64 vectors as doubles, filled up with zeros to ``dim``."""
    if all(len(x) == 8 * dim for x in packed):
        return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), dim).astype(np.float64)
    out = np.zeros((len(packed), dim))
    for i, x in enumerate(packed):
        out[i, : len(x) // 8] = np.frombuffer(x, "<i8")
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where no sum can leave 2**53, else by Python integers, kept within a long."""
    if q.size == 0 or x.size == 0:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the k highest scores among ids other than the row's own, ties to smaller ids: (row, id, score)."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    mine = own[:, None] == ids[None, :]
    rows, cols, out = [], [], []
    take = min(len(ids), k + int(mine.sum(axis=1).max(initial=0)))
    if take == 0:
        return (np.zeros(0, np.int64),) * 3
    edge = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
    hit_r, hit_c = np.nonzero((scores >= edge[:, None]) & ~mine)
    value = scores[hit_r, hit_c]
    by = np.lexsort((hit_c, -value, hit_r))
    hit_r, hit_c, value = hit_r[by], hit_c[by], value[by]
    place = np.arange(len(hit_r)) - np.searchsorted(hit_r, hit_r)
    keep = place < k
    rows, cols, out = hit_r[keep], ids[hit_c[keep]], value[keep]
    return rows, cols, out


def chain(pivots: np.ndarray) -> list[int]:
    """An order of the pivots in which each is followed by the nearest of those left, so that neighbours stand together."""
    square = (pivots * pivots).sum(axis=1)
    left = np.ones(len(pivots), bool)
    order = [0] if len(pivots) else []
    left[order] = False
    while left.any():
        far = square - 2 * (pivots @ pivots[order[-1]])
        order.append(int(np.where(left, far, np.inf).argmin()))
        left[order[-1]] = False
    return order


def needed(mid: np.ndarray, reach: np.ndarray, nearest: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
    """Which cells (columns) may hold one of the k best of each row, a query or a group of them. A row's inner products with
    the cells' pivots are ``mid`` give or take what the caller subtracts and adds by ``reach``: (products at least, products at
    most, length at most), each of which broadcasts over the cells. ``nearest`` holds the k + 1 least distances of each cell."""
    low, high, length = reach
    slack = 1e-9 * (np.abs(mid) + length * (radius + 1)[None, :]) + 1e-6
    sure = np.concatenate([low - length * nearest[None, :, j] - slack for j in range(nearest.shape[1])], axis=1)
    sure[~np.isfinite(sure)] = -np.inf
    want = min(k + 1, sure.shape[1])  # one more than k: the query itself may be among them
    floor = -np.partition(-sure, want - 1, axis=1)[:, want - 1]
    return high + length * radius[None, :] + slack >= floor[:, None]


def blocks_of(order: list[int], sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """The first block of each group of queries and the number of its blocks: groups larger than ``block`` have several of
    their own, smaller ones share a block with those next to them in ``order``."""
    found: dict[int, tuple[int, int]] = {}
    at, filled = 0, 0
    for g in (g for g in order if sizes.get(g)):
        if filled and filled + sizes[g] > block:
            at, filled = at + 1, 0
        parts = -(-sizes[g] // block)
        found[g] = at, parts
        at, filled = (at + parts, 0) if parts > 1 else (at, filled + sizes[g])
    return found


def top_k(data: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` (``id, v``) its k best rows of ``data`` (``id, v``),
    the row of its own id left out; all rows if they are fewer. Ties go to the smaller id. Both inputs are read more than
    once, so they should be stored tables. Rows that repeat an id count as that many vectors.
    """
    spark = data.sparkSession
    bounded_batches(spark, 4096)
    k = settings.k
    n, longest = data.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    longest_query = queries.agg(F.max(F.octet_length("v"))).first()[0]
    if not n or longest_query is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(longest, longest_query) // 8
    n_pivots = max(1, min(settings.most_pivots, math.isqrt(n) // 2))
    pivots = matrix([bytes(r[0]) for r in data.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").collect()], dim)
    sent = spark.sparkContext.broadcast(pivots)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        half = (p * p).sum(axis=1) / 2
        for batch in batches:
            x = matrix(batch.column(1).to_pylist(), dim)
            cell = (x @ p.T - half).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            length = np.sqrt((x * x).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(length)], ["id", "v", "cell", "far", "length"])

    in_cells = lambda rows, name: stored(rows.select("id", "v").mapInArrow(cells, "id long, v binary, cell int, far double, length double"), name)
    placed, asking = in_cells(data, "cells"), in_cells(queries, "queries")
    # k + 1 nearest of each cell, since the query itself may be one of them; ranked within salts first, so no cell is sorted in one task
    salt = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(64))
    near = placed.select("cell", "far", salt.alias("salt"))
    for by in (["cell", "salt"], ["cell"]):
        near = near.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("far"))).where(F.col("place") <= k + 1).drop("place")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    summary = sizes.join(near.groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near")), "cell").orderBy("cell").collect()  # a row a pivot
    cell_ids = np.array([r["cell"] for r in summary])
    radius = np.array([r["radius"] for r in summary])
    nearest = np.array([[*r["near"], *[np.inf] * (k + 1 - len(r["near"]))] for r in summary])
    splits = {r["cell"]: -(-r["n"] // settings.bucket) for r in summary}

    # groups of queries: which cells each needs, and the blocks its queries are in
    groups = asking.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("length").alias("length")).collect()  # a row a pivot
    place = blocks_of(chain(pivots), {r["cell"]: r["n"] for r in groups}, settings.block)
    long_pivots = np.sqrt((pivots[cell_ids] ** 2).sum(axis=1))[None, :]
    wanted: dict[int, set[int]] = {c: set() for c in cell_ids.tolist()}
    for r in groups:
        mid = pivots[r["cell"]][None, :] @ pivots[cell_ids].T
        off = r["radius"] * long_pivots * (1 + 1e-9)
        first, parts = place[r["cell"]]
        for j in np.flatnonzero(needed(mid, (mid - off, mid + off, np.array([[r["length"]]])), nearest, radius, k)[0]).tolist():
            wanted[int(cell_ids[j])].update(range(first, first + parts))
    facts = spark.sparkContext.broadcast((cell_ids, radius, nearest, [splits[c] for c in cell_ids.tolist()], wanted))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries go, packed by batch, to each bucket of each cell that may hold one of their best."""
        cell_ids, radius, nearest, parts, wanted = facts.value
        p = sent.value[cell_ids]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, packed = np.asarray(batch.column(0)), batch.column(1).to_pylist()
                block = np.asarray(batch.column(2))
                q = matrix(packed, dim)
                mid = q @ p.T
                open_ = needed(mid, (mid, mid, np.sqrt((q * q).sum(axis=1))[:, None]), nearest, radius, k)
                out: list[tuple] = []
                for b in np.unique(block).tolist():
                    mine = np.flatnonzero(block == b)
                    for j in np.flatnonzero(open_[mine].any(axis=0)).tolist():
                        if b in wanted[int(cell_ids[j])]:
                            of = mine[open_[mine, j]]
                            load = ids[of].astype("<i8").tobytes(), np.ascontiguousarray(q[of].astype("<i8")).tobytes()
                            out += [(f"{cell_ids[j]}:{s}:{b}", *load) for s in range(parts[j])]
                for a in range(0, len(out), 256):
                    bucket, qids, qs = zip(*out[a : a + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(qids, pa.binary()), pa.array(qs, pa.binary())], ["bucket", "qids", "qs"])

    lookup = lambda x: F.create_map(*[F.lit(v) for kv in x.items() for v in kv])[F.col("cell")]
    block = lookup({g: first for g, (first, _) in place.items()}) + F.pmod(F.xxhash64("id", F.lit(3)), lookup({g: parts for g, (_, parts) in place.items()}))
    asked = asking.select("id", "v", block.cast("int").alias("block")).mapInArrow(route, "bucket string, qids binary, qs binary")
    part = F.pmod(F.xxhash64("id", F.lit(5)), lookup(splits))
    goes = spark.createDataFrame([(c, sorted(to)) for c, to in wanted.items() if to], "cell int, blocks array<int>")
    bucketed = placed.join(goes, "cell").withColumn("block", F.explode("blocks")).select(F.concat_ws(":", "cell", part, "block").alias("bucket"), "id", "v")

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(rows) and len(asked):
            ids, x = rows["id"].to_numpy(), matrix(rows["v"].to_pylist(), dim)
            for qids, qs in zip(asked["qids"].to_pylist(), asked["qs"].to_pylist(), strict=True):
                own, q = np.frombuffer(qids, "<i8"), np.frombuffer(qs, "<i8").reshape(-1, dim).astype(np.float64)
                r, c, s = best(products(q, x), ids, own, k)
                found.append((own[r], c, s))
        q, c, s = (np.concatenate(a) for a in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": q, "vec_id": c, "score": s})

    local = bucketed.repartition(partitions(spark, 2), "bucket").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(search, "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = stored(whole_numbers(read_table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(data, data.where(F.col("id") % 50 == 0))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
           FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
