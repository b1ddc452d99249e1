"""Ranked lexical search, term at a time with a limited number of accumulators.

Documents are read once for a block of queries. Each Arrow batch becomes an inverted file of the terms the
queries ask for (documents and their counts), written to the checkpoint folder; collection statistics are sums over
these files. Then each task answers every query on its files: terms are taken rarest first, and a posting opens an
accumulator for its document only as long as the bounds of the terms that are left (weight times the largest impact in the file)
could still lift a document above the k-th best partial score. From then on only documents that have an accumulator are
updated, with all that is left, so their scores are exact and no document of the k best is missed. The k-th best score of the files a
task has done before counts from the start. Tasks return k rows a query; these are merged in levels of ``FAN_IN`` lists.

What travels to the tasks are the terms of a block of queries (``QUERY_BYTES`` of text on average; more queries make more
blocks) and a weight for each. 64-bit hashes stand for terms.

Defined cases: null and empty texts have no terms; a query without known terms gives no rows; repeated documents and
repeated queries are ranked each for itself; documents without an id come after others of equal score; extra columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import cut_lineage, spread, texts_of, word_hashes

#: Per cent of a document's length in its weight of length, and of none.
LENGTH, FLAT = 75, 25
#: Fixed factors of the score's integer arithmetic.
UNIT, SATURATION, STEEP = 1_000_000_000, 1000, 8
#: Text of the queries that are answered in one pass over the documents.
QUERY_BYTES = 4 << 20
FAN_IN = 64

#: A term is a longest run of ASCII letters and digits and of any characters beyond ASCII; only A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the terms of UTF-8 texts: text i has the terms offsets[i]:offsets[i + 1]."""
    hashes, offsets, _, _ = word_hashes([t.translate(_TERM_BYTES) for t in texts], lower=False)
    return hashes, offsets


@dataclass
class Queries:
    """Queries of one block: sorted vocabulary, and for each query its terms (places in it) and how often each occurs."""

    vocabulary: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]


def read_queries(texts: list[bytes]) -> Queries:
    hashes, offsets = term_hashes(texts)
    vocabulary = np.unique(hashes)
    found = [np.unique(np.searchsorted(vocabulary, hashes[a:b]), return_counts=True)
             for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return Queries(vocabulary, [t for t, _ in found], [c for _, c in found])


FILES = "n binary, term binary, size binary, doc binary, tf binary, docs bigint, terms bigint"


def inverted_files(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """One row for each batch of documents: ids, lengths and the postings of the vocabulary in order of term."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = term_hashes(texts_of(batch.column(1)))
            n = np.diff(offsets)
            at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
            known = np.flatnonzero(vocabulary[at] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            code, tf = np.unique(at[known] * max(len(n), 1) + owner[known], return_counts=True)
            term, doc = np.divmod(code, max(len(n), 1))
            which, size = np.unique(term, return_counts=True)
            rows = [batch.column(0).to_pylist()], *[[v.astype("<i8").tobytes()] for v in (n, which, size, doc, tf)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.list_(batch.schema.field(0).type)), *[pa.array(r, pa.binary()) for r in rows[1:]],
                 pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())],
                names=["ids", "n", "term", "size", "doc", "tf", "docs", "terms"])

    return docs.mapInArrow(build, f"ids array<{kind}>, {FILES}")


def document_frequencies(files: DataFrame, many: int) -> np.ndarray:
    """Documents that hold each term; every task returns one sum a term it has met."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for batch in batches:
            for term, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(term, "<i8")] += np.frombuffer(size, "<i8")
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["term", "df"])

    out = np.zeros(many, np.int64)
    for row in (files.select("term", "size").mapInArrow(count, "term bigint, df bigint")
                .groupBy("term").agg(F.sum("df").alias("df")).collect()):  # at most the vocabulary of the block
        out[row["term"]] = row["df"]
    return out


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def length_weights(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """FLAT plus LENGTH times the length over the mean length, in whole numbers."""
    if int(n.max(initial=0)) * LENGTH * documents < 1 << 62:
        return FLAT + (LENGTH * n * documents) // max(terms, 1)
    return np.array([FLAT + LENGTH * x * documents // terms for x in n.tolist()], np.int64)


class File:
    """Postings of one batch with the impact of each."""

    def __init__(self, row: dict, documents: int, terms: int) -> None:
        n, self.term, size, self.doc, tf = (np.frombuffer(row[c], "<i8") for c in ("n", "term", "size", "doc", "tf"))
        self.ids, self.docs = row["ids"], len(n)
        # Ids in order, those without one last: ties go to the smaller place.
        order = sorted(range(self.docs), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        self.order = np.empty(self.docs, np.int64)
        self.order[order] = np.arange(self.docs)
        m = length_weights(n, documents, terms)
        self.impact = UNIT * tf // (SATURATION * tf + STEEP * m[self.doc])
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(size) else np.zeros(0, np.int64)

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms the file has, and where."""
        if not len(self.term):
            return np.zeros(len(terms), bool), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.term, terms), len(self.term) - 1)
        return self.term[at] == terms, at


def search_file(file: File, terms: np.ndarray, factors: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, accumulators) of the documents that can be among the k best; ``floor``: a k-th score known before.

    ``terms`` are in order of frequency, rarest first; ``factors`` are their weights times their occurrences in the query.
    """
    has, at = file.places(terms)
    at, factors = at[has], factors[has]
    left = np.cumsum((factors * file.most[at])[::-1])[::-1] if len(at) else np.zeros(0, np.int64)
    total, opened, kth, step = np.zeros(file.docs, np.int64), np.zeros(file.docs, bool), floor, 0
    # A new document reaches ``left`` at most; with exactly the k-th score it may still win by its id.
    while step < len(at) and left[step] >= kth:
        a, b = file.start[at[step]], file.start[at[step] + 1]
        docs = file.doc[a:b]
        total[docs] += factors[step] * file.impact[a:b]
        opened[docs] = True
        step += 1
        if step < len(at) and left[step] < left[0]:
            partial = total[opened]
            if len(partial) >= k:
                kth = max(kth, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
    for i in range(step, len(at)):
        a, b = file.start[at[i]], file.start[at[i] + 1]
        docs = file.doc[a:b]
        mine = opened[docs]
        total[docs[mine]] += factors[i] * file.impact[a:b][mine]
    docs = np.flatnonzero(opened & (total > 0))
    many = len(docs)
    if many > k:
        least = np.partition(total[docs], many - k)[many - k]
        docs = docs[total[docs] >= least]
    docs = docs[np.lexsort((file.order[docs], -total[docs]))][:k]
    return docs, total[docs], many


def _merged(lists: DataFrame, k: int, parts: int) -> DataFrame:
    def best(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    while parts > FAN_IN:
        parts = parts // FAN_IN + 1
        lists = best(lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")), ["item", "part"])
    return best(lists, ["item"]).select("item", "rank", "doc_id", "score")


def _answers(docs: DataFrame, queries: Queries, items: list[int], k: int) -> DataFrame:
    """item, rank, doc_id, score of one block of queries."""
    files = cut_lineage(inverted_files(docs, queries.vocabulary))
    whole = (files.select("docs", "terms", F.spark_partition_id().alias("part"))
             .agg(F.sum("docs"), F.sum("terms"), F.max("part")).first())
    documents, terms, last = whole[0] or 0, whole[1] or 0, whole[2] or 0
    df = document_frequencies(files, len(queries.vocabulary))
    weight = term_weights(df, documents)
    asked = []
    for item, mine, times in zip(items, queries.terms, queries.times, strict=True):
        order = np.lexsort((mine, df[mine]))
        order = order[weight[mine[order]] > 0]  # a term that all documents hold adds nothing
        asked.append((item, mine[order], (weight[mine] * times)[order]))
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {item: [] for item, _, _ in asked}
        for batch in batches:
            for row in batch.to_pylist():
                file = File(row, documents, terms)
                for item, mine, factors in asked:
                    known = best[item]
                    found, scores, _ = search_file(file, mine, factors, k, known[-1][0] if len(known) == k else 0)
                    if len(found):
                        known += [(s, file.ids[d]) for s, d in zip(scores.tolist(), found.tolist(), strict=True)]
                        known.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
                        del known[k:]
        part = TaskContext.get().partitionId()
        rows = [(item, doc, score) for item, known in best.items() for score, doc in known]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32())],
            names=["item", "doc_id", "score", "part"])

    return _merged(files.mapInArrow(search, f"item bigint, doc_id {kind}, score bigint, part int"), k, last + 1)


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item, ties to the smaller doc_id."""
    docs = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    asked = cut_lineage(items.select(F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("_text"),
                                     F.monotonically_increasing_id().alias("item")))
    size = asked.agg(F.sum(F.octet_length("_text").cast("bigint"))).first()[0] or 0
    blocks = int(size) // query_bytes + 1
    out = None
    for block in range(blocks):
        rows = sorted(asked.where(spread("item", blocks) == block).select("item", "_text").collect())
        queries = read_queries([(r["_text"] or "").encode() for r in rows])
        found = _answers(docs, queries, [r["item"] for r in rows], k)
        out = found if out is None else out.unionByName(found)
    return out.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
