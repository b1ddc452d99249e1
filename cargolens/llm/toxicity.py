"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present or absent: its words, word pairs and pairs with one word between, lower-cased
(A-Z), cut at white space and ASCII punctuation, hashed to 2**BITS places. Learning goes through a bounded
sample of labelled rows in a fixed order, with a rate of its own for every coordinate and L1 sparsity; some
hundred weights remain, travel with the tasks and score every whole text.

Defined cases: null and empty texts are scored by the intercept; rows without a label are never learned from;
a table without usable labels gives every text 0.5; repeated labels of an id count once, by their largest;
a null id is in no held-out part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import free_name, mix, texts_of, word_hashes

BITS = 20
#: Learning: rate, offset, L1, L2, passes, and the bound of the sample in rows.
ALPHA, BETA, L1, L2, PASSES, SAMPLE_ROWS = 3.0, 1.0, 8.0, 0.0, 6, 12_000
THRESHOLD = 0.7

_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~",
                         bytes(range(97, 123)) + b" " * 32)
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every feature occurrence of many texts."""
    words, offsets, _, _ = word_hashes([t.translate(_PLAIN) for t in texts], lower=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    found = [(owner, mix(words) >> _SHIFT)]
    for step, factor in ((1, _PAIR), (2, _SKIP)):
        same = owner[:-step] == owner[step:]
        found.append((owner[:-step][same], mix(words[:-step] * factor + words[step:])[same] >> _SHIFT))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[self.places] = self.weights
        owner, place = features(texts)
        hit = dense[place] != 0
        once = np.unique(owner[hit] * (1 << BITS) + place[hit])
        values = np.zeros(1 << BITS)
        values[self.places] = self.weights
        return self.intercept + np.bincount(once >> BITS, values[once & ((1 << BITS) - 1)], minlength=len(texts))


def learn(rows: list[tuple[int, np.ndarray]], alpha: float = ALPHA, beta: float = BETA, l1: float = L1,
          l2: float = L2, passes: int = PASSES) -> Model:
    """FTRL-proximal over (label, distinct places) in the given order; place 2**BITS is the intercept."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    thin = np.full(size, l1)
    thin[-1] = 0.0

    def weights(zi: np.ndarray, root: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= bound, 0.0, (np.sign(zi) * bound - zi) / ((beta + root) / alpha + l2))

    rows = [(label, np.append(places, size - 1)) for label, places in rows]
    for _ in range(passes):
        for label, at in rows:
            zi, root = z[at], np.sqrt(n[at])
            w = weights(zi, root, thin[at])
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            after = n[at] + gradient * gradient
            z[at] = zi + gradient - (np.sqrt(after) - root) / alpha * w
            n[at] = after
    w = weights(z, np.sqrt(n), thin)
    places = np.flatnonzero(w[:-1])
    return Model(places, w[places], float(w[-1]))


def remainder(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled rows outside the held-out third, the first by a hash of the id."""
    sample = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (remainder(key) != 1))
              .groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    rows = (docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
            .join(F.broadcast(sample), F.col("_key") == F.col("_id")))  # at most sample_rows rows
    # A repeated id must not widen the sample.
    rows = rows.select(F.xxhash64("_id").alias("at"), "_label", "_text")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place = features(texts_of(batch.column(2)))
            once = np.unique(owner * (1 << BITS) + place)
            ends = np.searchsorted(once, np.arange(batch.num_rows + 1) << BITS)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                             pa.array((once & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["at", "label", "places"])

    marked = (rows.mapInArrow(places, "at long, label int, places array<int>")
              .orderBy("at", "label", "places").limit(sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            values = batch.column(2).flatten().to_numpy()
            ends = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            for i, (at, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                held.append((at, y, values[ends[i]:ends[i + 1]].astype(np.int64)))
        held.sort(key=lambda r: r[:2])
        model = learn([(y, p) for _, y, p in held])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(model.places, -1)), pa.array(np.append(model.weights, model.intercept))],
            names=["place", "weight"])

    # One bounded sample, one task; the few weights that remain come back.
    got = marked.repartition(1).mapInArrow(run, "place long, weight double").collect()
    kept = sorted((r["place"], r["weight"]) for r in got if r["place"] >= 0)
    return Model(np.array([k[0] for k in kept], dtype=np.int64), np.array([k[1] for k in kept], dtype=np.float64),
                 next((r["weight"] for r in got if r["place"] < 0), 0.0))


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with ``score`` and ``predicted``."""
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    last = free_name(df, "_text")
    rows = df.select(*kept, F.col(text).cast("string").alias(last))
    schema = rows.drop(last).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = 1.0 / (1.0 + np.exp(-np.clip(model.logits(texts_of(batch.column(len(kept)))), -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                names=[*kept, "score", "predicted"])

    return rows.mapInArrow(run, schema)
