"""Exact substring deduplication by Rabin-Karp hashes of every fixed-length token window.

A window of ``WINDOW`` consecutive words that also starts in a document with a smaller id is a repeat; overlapping
and touching repeats merge into maximal intervals, which are removed.

Windows are counted by messages between chunks of documents (by a hash of the id, of bounded bytes) and buckets of
hashes. A chunk tells each bucket every hash once, however often it occurs in its documents, so a passage that
stands in a third of all documents costs one entry for each chunk. Two rounds keep the messages small:

1. of each window only its smallest hash of ``ANCHOR`` words, in 40 bits: equal windows have equal anchors, so a
   window whose anchor is met in one document alone can't repeat (false matches only cost time);
2. of the windows that are left, the 64-bit hash and the smallest document of the chunk; the answer is the
   smallest document of all chunks.

The texts are dealt to their chunks once; the three steps that read them share that exchange.

Defined cases: null and empty texts have no words; texts shorter than a window keep all; documents of equal id do
not count as repeats of each other; rows with a null id keep all their words and repeat nothing; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .messages import ANSWER, MESSAGE, NARROW, distinct, member, shared_values, to_buckets, told, with_flags
from .shared import chunk_count, ngrams, place_of, spread, texts_of, word_hashes

WINDOW, ANCHOR = 13, 5
CHUNK_BYTES = 8 << 20


class _Chunk:
    """Windows of the documents of one chunk, end to end."""

    def __init__(self, table: pa.Table, window: int, anchor: int) -> None:
        self.ids = table.column("doc_id")
        known = self.ids.is_valid().to_numpy()
        # Ids are compared, so that any integer type will do; a null id takes part in nothing.
        self.order = self.ids.fill_null(0).to_numpy().astype(np.int64)
        self.texts = texts_of(table.column("_text"))
        self.words, self.offsets, self.starts, self.ends = word_hashes(self.texts, lower=False)
        owner = np.repeat(np.arange(len(self.texts)), np.diff(self.offsets))
        count = max(len(self.words) - window + 1, 0)
        whole = (owner[:count] == owner[window - 1:]) & known[owner[:count]] if count else np.zeros(0, bool)
        self.at = np.flatnonzero(whole)
        self.owner = owner[self.at]
        self.document = self.order[self.owner]
        self._window, self._anchor = window, anchor

    def hashes(self) -> np.ndarray:
        return ngrams(self.words, self._window)[self.at]

    def anchors(self) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, np.uint64)
        grams = ngrams(self.words, self._anchor) >> (np.uint64(64) - NARROW)
        wide = self._window - self._anchor + 1
        least = grams[:len(grams) - wide + 1].copy()
        for i in range(1, wide):
            np.minimum(least, grams[i:len(grams) - wide + 1 + i], out=least)
        return least[self.at]


def _answers(parts: list[tuple[int, np.ndarray]]) -> pa.Table:
    return pa.table({"chunk": pa.array([p[0] for p in parts], pa.int32()),
                     "data": pa.array([p[1].tobytes() for p in parts], pa.binary())})


def removed_spans(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                  anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word intervals, past-the-end), kept_text (kept words, one space).

    The columns of ``carry`` come with their row in the struct ``carried``; ids need not be unique for that.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("_text"),
                     *[F.col(c).alias(f"_{c}") for c in carry if c != text])
    n = chunk_count(docs, "_text", chunk_bytes)
    docs = docs.withColumn("chunk", spread(place_of("doc_id", "_text"), n))
    chunks = docs.groupBy("chunk")

    def tell_anchors(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, anchor)
        number = table.column("chunk")[0].as_py() if table.num_rows else 0
        values, _, several = distinct(chunk.anchors(), chunk.document)
        return to_buckets(number, values, 40, n, with_flags(values, several))

    def tell_windows(key_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, anchor)
        keep = member(chunk.anchors(), told(answers))
        values, least, _ = distinct(chunk.hashes()[keep], chunk.document[keep])
        return to_buckets(key_[0].as_py(), values, 64, n,
                           lambda a, b: values[a:b].tobytes() + least[a:b].tobytes())

    def first_documents(table: pa.Table) -> pa.Table:
        chunk, values, least = [], [], []
        for c, data in zip(table.column("chunk").to_pylist(), table.column("data").to_pylist(), strict=True):
            many = len(data) // 16
            values.append(np.frombuffer(data, "<u8", many))
            least.append(np.frombuffer(data, "<i8", many, 8 * many))
            chunk.append(np.full(many, c, np.int32))
        value, owner, document = np.concatenate(values), np.concatenate(chunk), np.concatenate(least)
        order = np.lexsort((document, value))
        value, owner, document = value[order], owner[order], document[order]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        sizes = np.diff(np.r_[first, len(value)])
        smallest = np.repeat(document[first], sizes)
        order = np.argsort(owner, kind="stable")
        rows = np.stack([value.view(np.int64), smallest], axis=1)[order]
        who, at = np.unique(owner[order], return_index=True)
        return _answers(list(zip(who.tolist(), np.split(rows, at[1:]) if len(who) else [], strict=True)))

    made = (T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_words", "long")
            .add("n_removed", "long").add("spans", T.ArrayType(T.ArrayType(T.LongType()))).add("kept_text", "string"))
    carried = [f"_{c}" if c != text else "_text" for c in carry]
    for c in carried:
        made = made.add(docs.schema[c])

    def remove(key_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, anchor)
        rows = [np.frombuffer(d, "<i8").reshape(-1, 2) for d in answers.column("data").to_pylist()]
        heard = np.concatenate(rows) if rows else np.zeros((0, 2), np.int64)
        covered = np.zeros(len(chunk.words) + 1, dtype=np.int64)
        if len(heard):
            order = np.argsort(heard[:, 0].view(np.uint64))
            value, least = heard[order, 0].view(np.uint64), heard[order, 1]
            own = chunk.hashes()
            near = np.minimum(np.searchsorted(value, own), len(value) - 1)
            hit = chunk.at[(value[near] == own) & (least[near] < chunk.document)]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + window, -1)
        gone = np.cumsum(covered[:-1]) > 0
        n_words, n_removed, spans, kept = [], [], [], []
        for i in range(len(chunk.texts)):
            low, high = chunk.offsets[i], chunk.offsets[i + 1]
            out = gone[low:high]
            n_words.append(int(high - low))
            n_removed.append(int(out.sum()))
            edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8))).reshape(-1, 2)
            spans.append(edge.tolist())
            # Words between two intervals are kept as they are; white space between them becomes one space.
            words = chunk.texts[i].split()
            if n_removed[-1]:
                words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
            kept.append(b" ".join(words))
        return pa.table({"doc_id": chunk.ids, "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                         **{c: table.column(c) for c in carried}})

    anchors = chunks.applyInArrow(tell_anchors, MESSAGE).groupBy("bucket").applyInArrow(shared_values, ANSWER)
    windows = (chunks.cogroup(anchors.groupBy("chunk")).applyInArrow(tell_windows, MESSAGE)
               .groupBy("bucket").applyInArrow(first_documents, ANSWER))
    out = chunks.cogroup(windows.groupBy("chunk")).applyInArrow(remove, made)
    if not carry:
        return out
    return out.select("doc_id", "n_words", "n_removed", "spans", "kept_text",
                      F.struct(*[F.col(a).alias(b) for a, b in zip(carried, carry, strict=True)]).alias("carried"))


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    return spans.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)
                        .alias("kept_sha256"))
