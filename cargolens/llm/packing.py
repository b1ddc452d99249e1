"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces go,
longest first, to the open sequence that fits under every capacity and scores best: least weighted norm of what
would remain, or largest weighted dot product of demand and remainder. Pieces of equal length are alike, so the
plan is made from the histogram of lengths (at most one entry for each length up to the capacity): a step places a
run of equal pieces into a run of equal sequences. The plan's size depends on the capacity, not on the corpus;
every piece finds its step by its rank among pieces of its length, which Spark counts by partition.

Defined cases: null and empty texts have the end id only and are packed like others; repeated rows are packed once
each; only texts longer than the capacity are cut; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .shared import cut_lineage, texts_of

#: Words remembered by one task, about 200 bytes each, and bytes of a word that is remembered: longer ones seldom come again.
REMEMBERED, LONGEST = 800_000, 48
#: New words encoded in one call.
TOGETHER = 256
#: Weights of tokens, documents and attention cost in the score.
WEIGHTS = (1.0, 0.3, 0.3)


class WordIds:
    """Ids of white-space separated words as little-endian unsigned 32-bit values; a word's ids don't depend on others."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; they are encoded as one text, and a token belongs to the word it starts in."""
        made = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        owner = np.searchsorted(starts, [a for a, _ in made.offsets], side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(words) + 1)) * 4
        ids = np.array(made.ids, "<u4").tobytes()
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, followed by id 0."""
        for at in range(0, len(texts), 64):
            # The model lower-cases; its special strings are told apart before that.
            split = [(t if b"<|" in t else t.lower()).split() for t in texts[at:at + 64]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            fresh = list(set().union(*split).difference(self.known))
            long_: dict[bytes, bytes] = {}
            for low in range(0, len(fresh), TOGETHER):
                part = fresh[low:low + TOGETHER]
                for w, ids in zip(part, self.of_words([w.decode("utf-8", "replace") for w in part]), strict=True):
                    (self.known if len(w) <= LONGEST else long_)[w] = ids
            for words in split:
                ids = map(self.known.__getitem__, words) if not long_ else (self.known[w] if w in self.known else long_[w] for w in words)
                yield b"".join(ids) + b"\0\0\0\0"


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(df: DataFrame, tokenizer: str, capacity: int, key: str = "doc_id", text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): texts longer than the capacity are cut into full pieces."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    schema = rows.drop("_text").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step = _words(tokenizer), 4 * capacity
        for batch in batches:
            which, piece, start, length, check, ids = [], [], [], [], [], []
            for i, data in enumerate(words.encode(texts_of(batch.column(1)))):
                for n, low in enumerate(range(0, len(data), step)):
                    part = data[low:low + step]
                    which.append(i)
                    piece.append(n)
                    start.append(low // 4)
                    length.append(len(part) // 4)
                    check.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            made = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())]
            if with_ids:
                made.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Plan:
    """Steps sorted by (length, rank): pieces rank.. of a length go to sequences first.., ``each`` to a sequence."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


def best_fit_plan(counts: dict[int, int], capacity: int, documents: int, attention: int,
                  weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> Plan:
    """Pack ``counts[length]`` pieces of each length. Sequences in one state have the same remaining capacities."""
    plan, full = Plan(), np.array([capacity, documents, attention], dtype=np.int64)
    scale = np.sqrt(np.array(weights)) / full
    room = np.zeros((1024, 3), dtype=np.int64)  # remaining capacities of each state, zero where unused
    bins: list[list[tuple[int, int]]] = [[] for _ in range(1024)]
    number: dict[tuple[int, int, int], int] = {}
    free = list(range(1023, -1, -1))

    def put(state: tuple[int, int, int], first: int, many: int) -> None:
        nonlocal room
        if min(state) <= 0 or not many:
            return  # full for good
        if state not in number:
            if not free:
                size = len(bins)
                room = np.concatenate((room, np.zeros_like(room)))
                bins.extend([] for _ in range(size))
                free.extend(range(2 * size - 1, size - 1, -1))
            number[state] = free.pop()
            room[number[state]] = state
        bins[number[state]].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        demand = np.array([length, 1, length * length], dtype=np.int64)
        if (demand > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            fits = np.flatnonzero((room >= demand).all(axis=1))
            if len(fits):
                if rule == "norm":
                    value = -(((room[fits] - demand) * scale) ** 2).sum(axis=1)
                else:
                    value = (room[fits] * scale * demand * scale).sum(axis=1)
                at = int(fits[np.argmax(value)])
                state = tuple(room[at].tolist())
                first, many = bins[at].pop()
                if not bins[at]:
                    del number[state]
                    room[at] = 0
                    free.append(at)
            else:
                state = tuple(full.tolist())
                each = min(int(f) // int(d) for f, d in zip(full, demand, strict=True))
                first, many = plan.sequences, -(-left // each)
                plan.sequences += many
            each = min(s // int(d) for s, d in zip(state, demand, strict=True))
            whole = min(many, left // each)
            rest = min(left - whole * each, each) if many > whole else 0
            for used, start, n in ((whole, first, each), (1 if rest else 0, first + whole, rest)):
                if used:
                    plan.length.append(length)
                    plan.rank.append(rank)
                    plan.first.append(start)
                    plan.each.append(n)
                    plan.offset.append(capacity - state[0])
                    rank += used * n
                    left -= used * n
                    put(tuple(s - n * int(d) for s, d in zip(state, demand, strict=True)), start, used)
            untouched = whole + (1 if rest else 0)
            put(state, first + untouched, many - untouched)
    return plan


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with ``_rank`` from 0 among all pieces of their length; input: written rows with ``_chunk``."""
    totals = pieces.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("length", "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_chunk", "length").orderBy("doc_id", "piece")
    return (pieces.withColumn("_in", F.row_number().over(inside)).join(totals, ["length", "_chunk"])
            .withColumn("_rank", F.col("_first") + F.col("_in") - 1).drop("_first", "_in", "_chunk"))


def pack(pieces: DataFrame, capacity: int = 2048, documents: int | None = None, attention: int | None = None,
         weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """The pieces with sequence_id and offset. A capacity left out is one that the token capacity implies."""
    # Written once, so that a piece's partition, and with it its rank, stays what it was.
    pieces = cut_lineage(pieces.withColumn("_chunk", F.spark_partition_id()))
    counts = {int(r["length"]): int(r["n"]) for r in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length at most
    plan = best_fit_plan(counts, capacity, documents or capacity, attention or capacity * capacity, weights, rule)
    order = np.lexsort((np.array(plan.rank), np.array(plan.length)))
    steps = np.array([plan.length, plan.rank, plan.first, plan.each, plan.offset], dtype=np.int64)[:, order]
    rows = ranked(pieces)
    schema = rows.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, each, offset = steps
        lengths, starts = np.unique(length, return_index=True)
        ends = np.append(starts[1:], len(length))
        for batch in batches:
            mine, at = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            step = np.zeros(len(mine), dtype=np.int64)
            for value in np.unique(mine):
                i = np.searchsorted(lengths, value)
                own = mine == value
                step[own] = starts[i] + np.searchsorted(rank[starts[i]:ends[i]], at[own], side="right") - 1
            inside = at - rank[step] if len(mine) else at
            sequence, place_in = inside // each[step], inside % each[step]
            kept = [batch.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(first[step] + sequence), pa.array(offset[step] + place_in * mine)], names=schema.names)

    return rows.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from packed pieces with ids; a sequence is bounded by its capacity."""
    return (packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
            .select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids")))
