"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``NEAREST`` pivots in order of inner product, directions taken from their common mean. Each
block of rows keeps an inverted file: for every pivot the rows that list it, with its position. A query reads the lists of its
own pivots and adds up how far the footrule distance falls below that of two disjoint lists, which is
2 * (NEAREST - max(position in query, position in row)) for each pivot they share.

Lists know directions only, nearness is the inner product. A line through the cosines of a sample of the block, with
``ABOVE`` deviations added, turns the footrule distance into a high guess of the cosine; with the parts of row and query
along the mean and the norm of the row, which are known exactly, it becomes a guess of the inner product and ranks the rows. Those of highest rank,
with all that tie with the last of them, are reranked by the inner product of the original vectors.

How many are reranked is measured in each block: up to ``TRIED`` of the queries are answered by brute force, and so many rows
are taken that ``SURE`` of their true neighbours are among them, times ``MARGIN``. Where lists tell little this can be the
whole block (an exact scan). So recall does not depend on how the vectors lie; the work does.

Pivots are a bounded sample: ``PIVOTS`` of the ``4 * PIVOTS`` rows of smallest id hash, each farthest from those taken
before. Every row is indexed, and every query is put to every block.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without an id, take no
part; rows that share an id count once, by their best score; equal distances and scores go to the smaller id;
vectors of a length no pivot has are compared exactly; no valid vector gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import spread
from .topk import LISTS, block_count, by_length, finite, merge_lists

PIVOTS, NEAREST = 256, 64
#: Least number of rows of a block that are reranked.
LEAST = 256
BLOCK_ROWS = 32_768
#: Queries answered by brute force in each block, share of their neighbours that has to be reranked, and factor for the other queries.
TRIED, SURE, MARGIN = 32, 0.99, 1.25
#: Rows of a block whose cosines are computed for the guess, and deviations added to it.
SAMPLE, ABOVE = 512, 2.0


@dataclass
class Frame:
    """Pivots (unit vectors) around the mean of the unit vectors."""

    mean: np.ndarray
    pivots: np.ndarray


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> dict[int, Frame]:
    """Pivots for each vector length, from a bounded sample."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("_v").limit(4 * pivots).collect()
    found: dict[int, list[tuple[float, ...]]] = {}
    for row in sample:
        found.setdefault(len(row["_v"]), []).append(tuple(row["_v"]))
    return {n: spread_out(np.array(list(dict.fromkeys(v)), dtype=np.float64), pivots) for n, v in found.items()}


def spread_out(vectors: np.ndarray, pivots: int) -> Frame:
    """Farthest first among the directions from the mean: a hot direction gets as many pivots as it has width."""
    unit = unit_rows(vectors)
    mean = unit.mean(axis=0)
    away = unit - mean
    length = np.linalg.norm(away, axis=1)
    if not (length > 1e-12).any():  # one direction
        return Frame(np.zeros_like(mean), unit[:1])
    away = away[length > 1e-12] / length[length > 1e-12, None]
    taken = [0]
    near = away @ away[0]
    while len(taken) < min(pivots, len(away)):
        at = int(np.argmin(near))
        if near[at] > 1 - 1e-12:
            break
        taken.append(at)
        near = np.maximum(near, away @ away[at])
    return Frame(mean, away[taken])


def permutations(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first."""
    similar = vectors @ pivots.T
    k = min(nearest, len(pivots))
    near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(similar, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1)


class InvertedFile:
    """For every pivot the rows of a block that list it and the position it has there."""

    def __init__(self, lists: np.ndarray, pivots: int) -> None:
        self.rows, self.nearest = lists.shape
        row, position = np.divmod(np.arange(lists.size), self.nearest)
        order = np.argsort(lists.ravel(), kind="stable")
        starts = np.searchsorted(lists.ravel()[order], np.arange(1, pivots))
        self.row = np.split(row[order], starts)
        self.position = np.split(position[order].astype(np.int32), starts)

    def closeness(self, listed: np.ndarray) -> np.ndarray:
        """Half the amount by which each row's footrule distance to a query is below the largest."""
        rows, positions = [self.row[p] for p in listed], [self.position[p] for p in listed]
        mine = np.repeat(np.arange(len(listed), dtype=np.int32), [len(r) for r in rows])
        gain = self.nearest - np.maximum(np.concatenate(positions), mine)
        return np.bincount(np.concatenate(rows), gain, minlength=self.rows)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def cosine_line(closeness: np.ndarray, cosines: np.ndarray) -> tuple[float, float]:
    """(a, b) with a + b * closeness a high guess of the cosine; b is positive."""
    c = closeness - closeness.mean()
    square = float((c * c).sum())
    b = max(float((c * cosines).sum()) / square if square else 0.0, 1e-9)
    left = cosines - b * closeness
    return float(left.mean() + ABOVE * left.std()), b


class Block:
    """Inverted file of a block of rows and what it takes to guess inner products from it."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, frame: Frame, nearest: int) -> None:
        self.rows, self.queries = rows, queries
        unit, asked = unit_rows(rows), unit_rows(queries)
        away, towards = unit - frame.mean, asked - frame.mean
        self.index = InvertedFile(permutations(away, frame.pivots, nearest), len(frame.pivots))
        self.lists = permutations(towards, frame.pivots, nearest)
        self.norm = np.linalg.norm(rows / np.abs(rows).max(), axis=1)
        self.length, self.length_asked = (np.maximum(np.linalg.norm(v, axis=1), 1e-300) for v in (away, towards))
        self.along, self.along_asked, square = unit @ frame.mean, asked @ frame.mean, float(frame.mean @ frame.mean)
        self.along -= square
        seen = np.arange(0, len(rows), -(-len(rows) // SAMPLE))
        some = np.arange(0, len(queries), -(-len(queries) // SAMPLE))
        self.line = cosine_line(np.array([self.index.closeness(self.lists[i])[seen] for i in some], dtype=float),
                                (towards[some] / self.length_asked[some, None]) @ (away[seen] / self.length[seen, None]).T)

    def guess(self, i: int) -> np.ndarray:
        a, b = self.line
        cosine = np.minimum(a + b * self.index.closeness(self.lists[i]), 1.0) if len(self.rows) else np.zeros(0)
        # (away + mean) * (towards + mean), of which only the first product is guessed.
        return (self.length * self.length_asked[i] * cosine + self.along + self.along_asked[i]) * self.norm

    def rows_needed(self, own: np.ndarray, k: int) -> int:
        """Rows to rerank so that SURE of the true neighbours of some queries are among them; ``own``: the query's own row or -1."""
        places = []
        for i in np.arange(0, len(self.queries), -(-len(self.queries) // TRIED)):
            true = np.einsum("ij,j->i", self.rows, self.queries[i])
            if own[i] >= 0:
                true[own[i]] = -np.inf
            best = np.argpartition(-true, min(k, len(true)) - 1)[:k]
            guessed = self.guess(i)
            places += [np.count_nonzero(guessed > guessed[j]) + 1 for j in best]
        return int(MARGIN * np.sort(places)[int(np.ceil(SURE * len(places))) - 1])


def search_block(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, rows: np.ndarray,
                 frame: Frame | None, k: int, nearest: int, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For every query its k best (ids, scores) of a block whose rows are in order of id."""
    block, many = None, len(c_ids)
    if frame is not None and least < len(c_ids) and len(q_ids):
        block = Block(rows, queries, frame, nearest)
        at = np.minimum(np.searchsorted(c_ids, q_ids), len(c_ids) - 1)
        many = max(least, block.rows_needed(np.where(c_ids[at] == q_ids, at, -1), k))
    out = []
    for i, query in enumerate(queries):
        if many >= len(c_ids):
            near = np.arange(len(c_ids))
        else:
            guessed = block.guess(i)
            near = np.flatnonzero(guessed >= np.partition(guessed, len(guessed) - many)[len(guessed) - many])
        near = near[c_ids[near] != q_ids[i]]
        # Row by row, so that equal vectors get equal scores wherever they stand.
        scores = np.einsum("ij,j->i", rows[near], query)
        order = np.lexsort((c_ids[near], -scores))
        ids, scores = c_ids[near][order], scores[order]
        _, once = np.unique(ids, return_index=True)
        once = np.sort(once)[:k]
        out.append((int(q_ids[i]), ids[once], scores[once]))
    return out


def nearest_neighbours(df: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", key: str = "vec_id",
                       pivots: int = PIVOTS, nearest: int = NEAREST, least: int = LEAST,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    rows = (df.where(finite(vector) & F.exists(vector, lambda x: x != 0) & F.col(key).isNotNull())
            .select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v")))
    chosen = choose_pivots(rows, pivots)
    asked = rows.where(F.col("vec_id") % every == 0)
    c_blocks = block_count(rows, block_rows)
    q_blocks = asked.count() // block_rows + 1
    left = (rows.withColumn("_c", spread("vec_id", c_blocks))
            .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    # New attributes for the second side: a cogroup of a table with itself would mix them up.
    right = (asked.select(F.col("vec_id").alias("vec_id"), F.col("_v").alias("_v"))
             .withColumn("_q", spread("vec_id", q_blocks))
             .withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))

    def pair(key_: tuple, table: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if table.num_rows and queries.num_rows:
            mine, theirs = by_length(table, "_v", np.float64), by_length(queries, "_v", np.float64)
            for n in theirs:
                if n in mine:
                    found += search_block(*theirs[n], *mine[n], chosen.get(n), k, nearest, least)
        sizes = [len(f[1]) for f in found]
        none = [np.zeros(0)]
        return pa.table({
            "query_id": pa.array(np.repeat(np.array([f[0] for f in found], np.int64), sizes)),
            "vec_id": pa.array(np.concatenate([f[1] for f in found] or none).astype(np.int64)),
            "score": pa.array(np.concatenate([f[2] for f in found] or none)),
            "part": pa.array(np.full(sum(sizes), key_[0].as_py(), np.int32))})

    lists = left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(pair, LISTS.format(score="double"))
    return merge_lists(lists, k, c_blocks)
