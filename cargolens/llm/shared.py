"""Helpers of the training-data operators: tables, reliable cuts, word hashes, packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scale import cut_lineage, session_settings

__all__ = ["table", "prepare", "cut_lineage", "parallelism", "chunk_count", "word_hashes", "ngrams", "mix",
           "normal_text", "place_of", "texts_of", "spread"]


def prepare(spark: SparkSession) -> None:
    session_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # of whole texts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Tasks that keep the session busy: the larger of its cores and its shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunk_count(df: DataFrame, column: str, chunk_bytes: int) -> int:
    """Chunks of about ``chunk_bytes``, from the measured bytes of a column; never fewer than the tasks."""
    total = df.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0
    return max(int(total) // chunk_bytes + 1, parallelism(df.sparkSession))


def spread(key: str | Column, n: int) -> Column:
    """A stable number in [0, n) from a key."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def place_of(key: str, text: str) -> Column:
    """A number that deals documents out: from the id, or from the text where there is none."""
    return F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(text))


def normal_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty texts."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of many UTF-8 texts at once.

    Returns (hashes, offsets, starts, ends): text i has the words offsets[i]:offsets[i + 1]; starts and
    ends are byte positions in the texts joined by one space.
    """
    joined = b" ".join(texts) + b" " * 9
    raw = np.frombuffer(joined, dtype=np.uint8)
    data = _LOWER[raw] if lower else raw
    gap = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    starts = starts[:len(ends)]
    lengths = ends - starts
    # Eight bytes at every position without copying; a word is read in steps of eight.
    wide = np.lib.stride_tricks.as_strided(data.view(), shape=(max(len(data) - 7, 0), 8), strides=(1, 1))
    out = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rest, at, rows = lengths, starts, None
    while len(rest):
        piece = np.ascontiguousarray(wide[at]).view(np.uint64).ravel() & _MASKS[np.minimum(rest, 8)]
        if rows is None:
            out = mix((out ^ piece) * np.uint64(0x9FB21C651E98DF25))
            rows = np.arange(len(rest))
        else:
            out[rows] = mix((out[rows] ^ piece) * np.uint64(0x9FB21C651E98DF25))
        more = rest > 8
        rest, at, rows = rest[more] - 8, at[more] + 8, rows[more]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    offsets = np.searchsorted(starts, bounds)
    return out, offsets, starts, ends


_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes (a polynomial in one odd factor, modulo 2**64, then mixed) of every n consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return words[:0]
    total = words[:count].copy()
    for j in range(1, n):
        total *= _FACTOR
        total += words[j:j + count]
    return mix(total)
