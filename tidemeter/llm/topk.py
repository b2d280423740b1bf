"""Exact top-k search by columnar branch-and-bound.

Vectors lie in blocks, one array per dimension. A query meets a block a few dimensions at a time; after
each step the candidates whose score so far plus the most that the remaining dimensions can add (the
product of the remaining norms) stays below the query's k-th best known score are dropped and the rest is
compacted. Dimensions come in order of falling energy, so little mass remains early. A query starts with
the k-th best score of its own block. Queries travel in blocks too: each block of queries meets each block
of candidates once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.llm.common import settle
from tidemeter.llm.packed import NULL_ID

K, EVERY = 20, 20
#: Vectors in a block, and dimensions in a step.
BLOCK, STEP = 4096, 16
#: Doubles hold sums of products below this size exactly.
EXACT = float(1 << 53)
#: A component whose scaled value exceeds this, the largest double, counts as this.
MOST = np.finfo(np.float64).max

_BLOCK = "block long, dims int, ids binary, data binary, energy array<double>"


def carried(x: np.ndarray, q: np.ndarray) -> bool:
    """Doubles give every score of ``q`` (queries x dimensions) and ``x`` (dimensions x candidates) exactly."""
    most = float(np.abs(x).max(initial=0)), float(np.abs(q).max(initial=0))
    return max(most) < EXACT and len(x) * most[0] * most[1] < EXACT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    task, made = TaskContext.get().partitionId(), 0

    def out(dims: int) -> pa.RecordBatch:
        nonlocal made
        ids = np.concatenate([x[0] for x in held[dims]])
        data = np.concatenate([x[1] for x in held.pop(dims)])
        made += 1
        with np.errstate(over="ignore"):
            energy = np.minimum((data ** 2).sum(0), 1e300)
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + made]), pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
             pa.array([np.ascontiguousarray(data.T).tobytes()], pa.binary()), pa.array([energy.tolist()], pa.list_(pa.float64()))],
            names=["block", "dims", "ids", "data", "energy"])

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            lists, ids = part.column("embedding"), part.column("vec_id").fill_null(int(NULL_ID)).to_numpy()
            sizes = lists.value_lengths().fill_null(-1).to_numpy()
            flat = lists.flatten()
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy()
            starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
            bad = np.concatenate(([0], np.cumsum(bad | ~np.isfinite(values))))
            good = (sizes >= 0) & (bad[starts[1:]] == bad[starts[:-1]])
            for dims in np.unique(sizes[good]).tolist():
                rows = np.flatnonzero(good & (sizes == dims))
                with np.errstate(over="ignore"):
                    data = np.floor(np.clip(64 * values[starts[rows][:, None] + np.arange(dims)], -MOST, MOST))
                held.setdefault(dims, []).append((ids[rows], data))
                if sum(len(x[0]) for x in held[dims]) >= BLOCK:
                    yield out(dims)
    for dims in list(held):
        yield out(dims)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, least: float, k: int, skip: int = -1, first: np.ndarray | None = None):
    """Places in ``ids`` and scores of the best ``k`` columns of ``x`` (dimensions x candidates) of at least ``least``.

    ``first`` holds the scores over the first step, where they were computed for many queries at once.
    """
    dims, n = x.shape
    at = np.arange(n)
    score = first if first is not None else q[:STEP] @ x[:STEP]
    if skip >= 0:
        at = np.delete(at, skip)
        score = np.delete(score, skip)
    for lo in range(STEP, dims, STEP):
        rest = np.sqrt((q[lo:] ** 2).sum())
        keep = score + rest * _rests(x, lo)[at] * (1 + 1e-9) + 1e-6 >= least
        at, score = at[keep], score[keep]
        score = score + q[lo: lo + STEP] @ x[lo: lo + STEP, at]
        if len(score) > k:
            least = max(least, _bound(q, x, at, score, lo + STEP, k))
    keep = score >= least
    at, score = at[keep], score[keep]
    best = _best(score, ids[at], k)
    return at[best], score[best]


def _rests(x: np.ndarray, lo: int) -> np.ndarray:
    """Norms of what follows dimension ``lo``; of the last block asked for they are kept."""
    kept = _RESTS.get("x")
    if kept is None or kept[0] is not x:
        kept = _RESTS["x"] = (x, {})
    if lo not in kept[1]:
        kept[1][lo] = np.sqrt((x[lo:] ** 2).sum(0))
    return kept[1][lo]


_RESTS: dict = {}


def _bound(q: np.ndarray, x: np.ndarray, at: np.ndarray, score: np.ndarray, lo: int, k: int) -> float:
    """The k-th highest of the least that each candidate can reach."""
    low = score if lo >= x.shape[0] else score - np.sqrt((q[lo:] ** 2).sum()) * _rests(x, lo)[at] * (1 + 1e-9) - 1e-6
    return float(np.partition(low, len(low) - k)[len(low) - k])


def _exactly(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, skip: int):
    """Whole-number arithmetic for components that doubles cannot carry; scores stop at the range of a long."""
    whole = [[int(v) for v in column] for column in x.T]
    mine = [int(v) for v in q]
    scores = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(mine, c, strict=True)))) for c in whole]
    order = sorted((i for i in range(len(ids)) if i != skip), key=lambda i: (-scores[i], ids[i]))[:k]
    return np.array(order, np.int64), np.array([scores[i] for i in order], np.int64)


def _arrays(row: dict, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["data"], np.float64).reshape(row["dims"], len(ids))
    return ids, np.ascontiguousarray(x[order]) if len(order) == len(x) else x


def _queries(every: int, k: int, orders: dict[int, list[int]]):
    """Each block's queries with their places and the k-th best score inside the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = _arrays(row, np.array(orders[row["dims"]], np.int64))
                places = np.flatnonzero((ids % every == 0) & (ids != NULL_ID))
                least = np.full(len(places), -np.inf)
                if carried(x, x) and len(ids) > k:
                    for i, p in enumerate(places.tolist()):
                        _, scores = search(x[:, p], x, ids, -np.inf, k, p)
                        least[i] = scores[-1]
                if len(places):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]]), pa.array([row["dims"]], pa.int32()), pa.array([places.astype(np.int32).tobytes()], pa.binary()),
                         pa.array([ids[places].tobytes()], pa.binary()), pa.array([x[:, places].T.tobytes()], pa.binary()), pa.array([least.tobytes()], pa.binary())],
                        names=["q_block", "q_dims", "q_places", "q_ids", "q_data", "q_least"])
    return run


def _meet(k: int, orders: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "q_block", "q_dims", "dims")}
                if row["dims"] != row["q_dims"]:
                    continue
                if kept[0] != row["block"]:
                    row |= {c: batch.column(c)[i].as_py() for c in ("ids", "data")}
                    kept = (row["block"], *_arrays(row, np.array(orders[row["dims"]], np.int64)))
                _, ids, x = kept
                places, mine, least = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("q_places", np.int32), ("q_ids", np.int64), ("q_least", np.float64)))
                q = np.frombuffer(batch.column("q_data")[i].as_py(), np.float64).reshape(len(mine), row["q_dims"])
                plain = carried(x, q)
                first = q[:, :STEP] @ x[:STEP] if plain else None
                out: list[list] = [[], [], [], []]
                for j in range(len(mine)):
                    skip = int(places[j]) if row["block"] == row["q_block"] else -1
                    at, scores = search(q[j], x, ids, least[j], k, skip, first[j]) if plain else _exactly(q[j], x, ids, k, skip)
                    out[0].append(np.full(len(at), places[j], np.int64))
                    out[1].append(np.full(len(at), mine[j]))
                    out[2].append(ids[at])
                    out[3].append(scores.astype(np.int64))
                place, query, vec, score = (np.concatenate(o) for o in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), row["q_block"])), pa.array(place), pa.array(query),
                     pa.array(vec, mask=vec == NULL_ID), pa.array(score)],
                    names=["q_block", "q_place", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by ``every``, the ``k`` other
    rows of highest integer inner product of ``floor(64 * x)``; ties go to the smaller id (null first).

    Rows without a vector, or with a null or non-finite component, take no part; vectors of other length
    are not compared. A component beyond the largest double after scaling counts as that, and scores stop at the
    range of a long. A repeated id is a query, and a candidate, each time; a null id is no query.
    Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = settle(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    energy = blocks.select("dims", F.posexplode("energy").alias("d", "e")).groupBy("dims", "d").agg(F.sum("e").alias("e"))
    orders: dict[int, list] = {d: [] for d, in blocks.select("dims").distinct().collect()}
    for dims, d, e in energy.toLocalIterator():  # a row for each dimension
        orders[dims].append((-e, d))
    ranked = {dims: [d for _, d in sorted(x)] for dims, x in orders.items()}
    slots = max(1, blocks.count())
    asked = blocks.mapInArrow(_queries(every, k, ranked), "q_block long, q_dims int, q_places binary, q_ids binary, q_data binary, q_least binary")
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    met = blocks.drop("energy").withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")).join(asked, "slot")
    found = met.mapInArrow(_meet(k, ranked), "q_block long, q_place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
