"""Exact top-k by tiles: matrix products of query and candidate blocks, partial selection, merged lists.

Queries and candidates are dealt to blocks by a hash of their id; one task multiplies one pair of blocks, in
inner tiles of bounded size, and keeps the best k of each query. The short lists are merged in levels of at
most ``FAN_IN`` lists, so no task gathers a query's lists from all blocks at once.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without
an id; vectors of different lengths have no product with each other; rows that share an id count as one
candidate with its best score and as one query; ties go to the smaller id; no valid vector gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import parallelism, spread

#: Most rows of a block: with 64 doubles a vector, 16 MB.
BLOCK_ROWS = 32_768
#: Queries and candidates of one inner product, 8 MB of scores.
TILE_QUERIES, TILE_ROWS = 128, 8_192
FAN_IN = 64
#: Rows that a block has at least, unless there are fewer: below, its lists are longer than its work.
LEAST_ROWS = 1024

LISTS = "query_id long, vec_id long, score {score}, part int"


def finite(vector: str) -> Column:
    """True for a vector of finite components without nulls."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))),
                      F.lit(False)) & (F.size(vector) > 0)


def quantized(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as a 64-bit integer."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def matrix(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the length of each list."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):  # an empty column
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), lengths


def by_length(table: pa.Table, vector: str, dtype) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length, in order of id."""
    ids = table.column("vec_id").to_numpy()
    values, lengths = matrix(table.column(vector), dtype)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[n] = ids[rows], values[starts[rows][:, None] + np.arange(n)]
    return out


def best_of_row(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, best first, ties to the smaller position."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        above = np.flatnonzero(scores > least)
        picked = np.concatenate((above, np.flatnonzero(scores == least)[:k - len(above)]))
        picked.sort()
    else:
        picked = np.arange(len(scores))
    return picked[np.argsort(-scores[picked], kind="stable")]


def best_of_tiles(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, rows: np.ndarray, k: int
                  ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query its k best (ids, scores) among the rows, which are in order of id."""
    first = np.flatnonzero(np.r_[True, c_ids[1:] != c_ids[:-1]])
    same = len(first) < len(c_ids)
    for at in range(0, len(q_ids), TILE_QUERIES):
        block = queries[at:at + TILE_QUERIES]
        held: list[list] = [[] for _ in block]
        for low in range(0, len(c_ids), TILE_ROWS):
            products = block @ rows[low:low + TILE_ROWS].T
            own = c_ids[low:low + TILE_ROWS]
            for i, scores in enumerate(products):
                ids = own
                keep = ids != q_ids[at + i]
                if not keep.all():
                    ids, scores = ids[keep], scores[keep]
                if same and len(ids):
                    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                    ids, scores = ids[starts], np.maximum.reduceat(scores, starts)
                top = best_of_row(scores, k)
                held[i].append((ids[top], scores[top]))
        for i, parts in enumerate(held):
            ids, scores = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            if same:
                _, once = np.unique(ids, return_index=True)
                once.sort()
                ids, scores = ids[once], scores[once]
            yield int(q_ids[at + i]), ids[:k], scores[:k]


#: Integer products up to this bound are exact in doubles, where they are fastest.
EXACT = 2.0 ** 53


def _product_type(queries: pa.Table, rows: pa.Table, integer: bool):
    if not integer:
        return np.float64
    large = [max((abs(int(v)) for v in (np.min(x), np.max(x))), default=0) if len(x) else 0
             for x in (matrix(t.column("_v"), np.int64)[0] for t in (queries, rows))]
    widest = max(matrix(queries.column("_v"), np.int64)[1].max(initial=0), 1)
    bound = large[0] * large[1] * int(widest)
    if bound < EXACT:
        return np.float64
    if bound < 2 ** 63:
        return np.int64
    raise OverflowError("a score does not fit into 64 bits")


def block_count(df: DataFrame, block_rows: int) -> int:
    """Blocks of at most ``block_rows`` rows (on average), and enough of them to keep the session busy."""
    rows = df.count()
    return max(rows // block_rows, min(2 * parallelism(df.sparkSession), rows // LEAST_ROWS)) + 1


def top_lists(candidates: DataFrame, queries: DataFrame, k: int, integer: bool,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, vec_id, score: the k best candidates of every query. Both inputs: vec_id and _v (a list)."""
    c_blocks = block_count(candidates, block_rows)
    q_blocks = queries.count() // block_rows + 1
    left = (candidates.withColumn("_c", spread("vec_id", c_blocks))
            .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    # New attributes for the second side: a cogroup of a table with itself would mix them up.
    right = (queries.select(F.col("vec_id").alias("vec_id"), F.col("_v").alias("_v"))
             .withColumn("_q", spread("vec_id", q_blocks))
             .withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))
    kind = "long" if integer else "double"

    def pair(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        got: list[tuple[int, np.ndarray, np.ndarray]] = []
        if rows.num_rows and asked.num_rows:
            dtype = _product_type(asked, rows, integer)
            mine, theirs = by_length(rows, "_v", dtype), by_length(asked, "_v", dtype)
            for n in theirs:
                if n in mine:
                    got += best_of_tiles(*theirs[n], *mine[n], k)
        sizes = [len(g[1]) for g in got]
        score = np.concatenate([g[2] for g in got]) if got else np.zeros(0)
        return pa.table({
            "query_id": pa.array(np.repeat(np.array([g[0] for g in got], np.int64), sizes)),
            "vec_id": pa.array(np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)),
            "score": pa.array(score.astype(np.int64) if integer else score.astype(np.float64)),
            "part": pa.array(np.full(sum(sizes), key[0].as_py(), np.int32))})

    lists = left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(pair, LISTS.format(score=kind))
    return merge_lists(lists, k, c_blocks)


def merge_lists(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """query_id, rank, vec_id, score from lists numbered by ``part``, merged level by level."""
    def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
        once = rows.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc())
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    while parts > FAN_IN:
        parts = parts // FAN_IN + 1
        lists = ranked(lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")), ["query_id", "part"])
    return ranked(lists, ["query_id"]).select("query_id", "rank", "vec_id", "score")


def exact_top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vector: str = "embedding",
                key: str = "vec_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k highest integer inner products of each query (id divisible by ``every``) against all other rows."""
    rows = (df.where(finite(vector) & F.col(key).isNotNull())
            .select(F.col(key).cast("bigint").alias("vec_id"), quantized(vector, scale).alias("_v")))
    asked = rows.where(F.col("vec_id") % every == 0)
    return top_lists(rows, asked, k, True, block_rows)
