"""Exact join of documents by the Jaccard similarity of their word n-grams.

The join is a blocked sparse product of the document by n-gram incidence matrix with its transpose: overlaps are
accumulated block by block and pairs below bounds from the set sizes are discarded. Every step before the
product only removes what can't link, so nothing is lost at the threshold (in hundredths, t):

1. Documents with equal sets are one class. A class is known by the 64-bit fingerprint of its set.
2. Of a partner's set at least ceil(t/100 * size) n-grams are common, so at most the rest may be missing from all
   other classes. Chunks tell buckets the n-grams in a fixed fraction of the hash space (all of them for small
   sets); classes with too many that nobody else has are done.
3. What is left is grouped by minimum hashes (groups split to at most ``GROUP_ROWS``); one dense product for each
   group links its members and emits a spanning forest. This only shrinks the problem: rows of one component need
   no more pairs among themselves, however large a group of near copies is.
4. The rest is exact again: n-grams are ordered by the number of components that hold them, rarest first (those of
   one component come before all and post nothing); a class posts the shortest prefix that any partner must meet.
   Classes of different components that meet are held against bounds: of their sizes, of what can follow the first
   common element, and of the ranges of the hash space their elements fall into. The few pairs that are left are
   compared in full. Long posting lists are cut into tiles.

Links feed connected components; the links between copies are implied by their class.

Defined cases: null and empty texts have the empty set, are linked with nothing and are their own component; texts
of fewer words than ``n`` have their whole sequence as the one element; repeated rows are copies; a row with a
null id gets the smallest id of its class or component, or null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .messages import (ANSWER, MESSAGE, NARROW, distinct, member, narrow, shared_values, to_buckets, told, wide,
                       with_flags)
from .shared import chunk_count, cut_lineage, mix, ngrams, parallelism, place_of, spread, texts_of, word_hashes

WORDS, THRESHOLD = 5, 80
CHUNK_BYTES = 8 << 20
#: Fraction of the hash space that larger sets tell in step 2, and the size up to which sets tell everything.
TOLD, SMALL_SET = 0.4, 40
#: Minimum hashes: all groups by the first; those of at least ``HOT_ROWS`` by all.
SEEDS, HOT_ROWS, GROUP_ROWS = 4, 48, 512
#: Columns of one dense product, and posting rows of one tile.
COLUMNS, TILE_ROWS = 4096, 2048


def least_overlap(size: np.ndarray | int, threshold: int):
    """Common elements that any partner of a set needs."""
    return -(-threshold * size // 100)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    words, offsets, _, _ = word_hashes(texts, lower=True)
    out = []
    for low, high in zip(offsets[:-1], offsets[1:]):
        if high - low >= n:
            out.append(np.unique(ngrams(words[low:high], n)))
        elif high > low:
            out.append(mix(ngrams(words[low:high], int(high - low)) + np.uint64(int(high - low))))
        else:
            out.append(words[:0])
    return out


def fingerprint(values: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    total = np.array([mix(values).sum(dtype=np.uint64), len(values)], dtype=np.uint64)
    return int(mix(mix(total)[:1] ^ total[1:]).view(np.int64)[0])


def set_rows(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """doc_id, place, n_shingles and the fingerprint ``node`` of every document."""
    rows = df.select(F.col(key).alias("doc_id"), place_of(key, text).alias("place"),
                     F.col(text).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("n_shingles", "long").add("node", "long")

    def run(batches):
        for batch in batches:
            sets = shingle_sets(texts_of(batch.column(2)), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([fingerprint(s) for s in sets], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _told_below(size: int) -> np.uint64:
    """Hashes of a set of this size below this bound are told."""
    return np.uint64(2 ** 64 - 1) if size <= SMALL_SET else np.uint64(int(TOLD * 2 ** 64))


def _counted_below(size: int, threshold: int) -> np.uint64:
    """Hashes that every possible partner tells as well."""
    return _told_below(size * 100 // threshold)


class _Chosen:
    """The classes of a chunk that are still open, one document each."""

    def __init__(self, table: pa.Table, nodes: list[int], n: int) -> None:
        wanted, self.nodes, self.sets = set(nodes), [], []
        for values in shingle_sets(texts_of(table.column("_text")), n) if wanted else []:
            node = fingerprint(values)
            if len(values) and node in wanted:
                wanted.discard(node)
                self.nodes.append(node)
                self.sets.append(values)


def candidates(df: DataFrame, classes: DataFrame, key: str, text: str, n: int, threshold: int,
               chunk_bytes: int) -> DataFrame:
    """Steps 1 and 2: node, size and shingles of the classes that may have a partner."""
    docs = df.select(place_of(key, text).alias("_place"), F.col(text).cast("string").alias("_text"))
    count = chunk_count(docs, "_text", chunk_bytes)
    docs = docs.select("_text", spread("_place", count).alias("chunk"))
    # A chunk's list is bounded by its documents.
    chosen = (classes.select(spread("place", count).alias("chunk"), "node")
              .groupBy("chunk").agg(F.collect_list("node").alias("nodes")))

    def tell(key_: tuple, table: pa.Table, nodes: pa.Table) -> pa.Table:
        listed = [v for row in nodes.column("nodes").to_pylist() for v in row]
        open_ = _Chosen(table, listed, n)
        values = [s[s < _told_below(len(s))] >> (np.uint64(64) - NARROW) for s in open_.sets]
        owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
        value, _, several = distinct(np.concatenate(values) if values else np.zeros(0, np.uint64), owner)
        return to_buckets(key_[0].as_py(), value, 40, count, with_flags(value, several))

    by_chunk = docs.groupBy("chunk")
    shared = (by_chunk.cogroup(chosen.groupBy("chunk")).applyInArrow(tell, MESSAGE)
              .groupBy("bucket").applyInArrow(shared_values, ANSWER))
    # What a chunk hears: its classes once more, and the n-grams that others have.
    heard = (chosen.select("chunk", "nodes", F.lit(None).cast("binary").alias("data"))
             .unionByName(shared.select("chunk", F.lit(None).cast("array<bigint>").alias("nodes"), "data")))

    def keep(key_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        listed = [v for row in answers.column("nodes").to_pylist() if row for v in row]
        common = told(answers.filter(answers.column("data").is_valid()))
        open_ = _Chosen(table, listed, n)
        nodes, sets = [], []
        for node, values in zip(open_.nodes, open_.sets, strict=True):
            seen = values[values < _counted_below(len(values), threshold)] >> (np.uint64(64) - NARROW)
            missing = len(seen) - int(member(seen, common).sum())
            if missing <= len(values) - least_overlap(len(values), threshold):
                nodes.append(node)
                sets.append(values.view(np.int64))
        return pa.table({"node": pa.array(nodes, pa.int64()), "size": pa.array([len(s) for s in sets], pa.int32()),
                         "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return by_chunk.cogroup(heard.groupBy("chunk")).applyInArrow(keep, "node long, size int, shingles array<long>")


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    lists = table.column("shingles").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        return [np.array(v, dtype=np.int64) for v in lists.to_pylist()]
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of every two sets: dense products of blocks of shared columns."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(count), -1)
    number[shared] = np.arange(len(shared))
    column = number[column]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        block = np.zeros((len(sets), min(COLUMNS, len(shared) - low)), dtype=np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        total += block @ block.T
    return total.astype(np.int64)


def linked(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which pairs of sets link."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    common = overlaps(sets)
    return 100 * common >= threshold * (sizes[:, None] + sizes[None, :] - common)


def forest(near: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] < 0:
            label[i], edge = i, np.array([i])
            while len(edge):
                edge = np.flatnonzero(near[edge].any(axis=0) & (label < 0))
                label[edge] = i
    return label


def group_links(sets: DataFrame, threshold: int) -> DataFrame:
    """Step 3: links (a, b) inside groups of equal minimum hashes."""
    def keys(batches):
        for batch in batches:
            rows = _sets_of(pa.Table.from_batches([batch]))
            least = [[int(mix(r.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F * (s + 1) % 2 ** 64)).min().view(np.int64))
                      for s in range(SEEDS)] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.list_(pa.int64()))],
                                             names=["node", "least"])

    mins = cut_lineage(sets.select("node", "shingles").mapInArrow(keys, "node long, least array<long>")
                       .select("node", F.posexplode("least").alias("seed", "least")))
    groups = mins.groupBy("seed", "least").agg(F.count(F.lit(1)).alias("rows"))
    groups = groups.where((F.col("rows") >= HOT_ROWS) | (F.col("rows") > 1) & (F.col("seed") == 0))
    placed = (mins.join(groups, ["seed", "least"])
              .select("node", "seed", "least",
                      F.pmod(F.xxhash64("node", "seed"), F.ceil(F.col("rows") / GROUP_ROWS)).alias("salt")))
    rows = placed.join(sets, "node")

    def link(key_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes = table.column("node").to_numpy()
        root = forest(linked(_sets_of(table), threshold))
        other = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(nodes[other]), "b": pa.array(nodes[root[other]])})

    return rows.groupBy("seed", "least", "salt").applyInArrow(link, "a long, b long")


def postings(sets: DataFrame, threshold: int, chunks: int) -> DataFrame:
    """Step 4, first half: every prefix element that other components hold as well, with the elements that follow it."""
    rows = sets.withColumn("chunk", spread("node", chunks))
    by_chunk = rows.groupBy("chunk")

    def tell(key_: tuple, table: pa.Table) -> pa.Table:
        own = _sets_of(table)
        element = np.concatenate(own).view(np.uint64) >> (np.uint64(64) - NARROW)
        comp = np.repeat(table.column("comp").to_numpy(), [len(s) for s in own])
        order = np.lexsort((comp, element))
        element, comp = element[order], comp[order]
        new = np.r_[True, (element[1:] != element[:-1]) | (comp[1:] != comp[:-1])]
        element, comp = element[new], comp[new]
        return to_buckets(key_[0].as_py(), element, 40, chunks,
                          lambda a, b: narrow(element[a:b]) + comp[a:b].tobytes())

    def count(table: pa.Table) -> pa.Table:
        elements, comps, owners = [], [], []
        for c, data in zip(table.column("chunk").to_pylist(), table.column("data").to_pylist(), strict=True):
            many = len(data) // 13
            elements.append(wide(data[:5 * many]))
            comps.append(np.frombuffer(data[5 * many:], "<i8"))
            owners.append(np.full(many, c, np.int32))
        element, comp, owner = map(np.concatenate, (elements, comps, owners))
        order = np.lexsort((comp, element))
        element, comp, owner = element[order], comp[order], owner[order]
        first = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
        fresh = np.r_[True, (element[1:] != element[:-1]) | (comp[1:] != comp[:-1])]
        held = np.repeat(np.add.reduceat(fresh, first, dtype=np.int64), np.diff(np.r_[first, len(element)]))
        element, held, owner = element[held > 1], held[held > 1], owner[held > 1]
        order = np.lexsort((element, owner))
        element, held, owner = element[order], np.minimum(held[order], 2 ** 31), owner[order]
        once = np.r_[True, (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])] if len(element) else []
        element, held, owner = element[once], held[once], owner[once]
        who, at = np.unique(owner, return_index=True)
        parts = zip(np.split(element, at[1:]), np.split(held, at[1:]), strict=True) if len(who) else []
        return pa.table({"chunk": pa.array(who, pa.int32()),
                         "data": pa.array([narrow(e) + h.astype("<u4").tobytes() for e, h in parts], pa.binary())})

    heard = by_chunk.applyInArrow(tell, MESSAGE).groupBy("bucket").applyInArrow(count, ANSWER)

    def post(key_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        elements, helds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for data in answers.column("data").to_pylist():
            many = len(data) // 9
            elements.append(wide(data[:5 * many]))
            helds.append(np.frombuffer(data[5 * many:], "<u4").astype(np.int64))
        element, held = np.concatenate(elements), np.concatenate(helds)
        order = np.argsort(element)
        element, held = element[order], held[order]
        out = []
        for i, values in enumerate(_sets_of(table) if len(element) else []):
            short = values.view(np.uint64) >> (np.uint64(64) - NARROW)
            at = np.minimum(np.searchsorted(element, short), len(element) - 1)
            many = np.where(element[at] == short, held[at], 1)
            prefix = np.lexsort((values, short, many))[:len(values) - least_overlap(len(values), threshold) + 1]
            place = np.flatnonzero(many[prefix] > 1)
            out.append((i, values[prefix[place]], len(values) - 1 - place))
        repeat = np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out])
        none = [np.zeros(0, np.int64)]
        return pa.table({"element": pa.array(np.concatenate([o[1] for o in out] or none)),
                         **{c: table.column(c).take(pa.array(repeat)) for c in ("node", "comp", "size")},
                         "rest": pa.array(np.concatenate([o[2] for o in out] or none).astype(np.int32))})

    again = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    return again.groupBy("chunk").cogroup(heard.groupBy("chunk")).applyInArrow(
        post, "element long, node long, comp long, size int, rest int")


def sketches(sets: DataFrame) -> DataFrame:
    """node and ``counts``: how many elements of the set fall into each of 2**j ranges, at least one range an element."""
    def run(batches):
        for batch in batches:
            made = []
            for values in _sets_of(pa.Table.from_batches([batch])):
                bits = max(len(values) - 1, 1).bit_length()
                made.append(np.minimum(np.bincount(values.view(np.uint64) >> np.uint64(64 - bits), minlength=1 << bits), 255)
                            .astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "counts"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, counts binary")


def overlap_bounds(counts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most elements that sets x[i] and y[i] can share, by the ranges they fall into."""
    width = np.array([len(c) for c in counts])
    out = np.zeros(len(x), dtype=np.int64)
    for least in np.unique(np.minimum(width[x], width[y])) if len(x) else ():
        rows = np.flatnonzero(np.minimum(width[x], width[y]) == least)
        used, place = np.unique(np.concatenate([x[rows], y[rows]]), return_inverse=True)
        # A finer sketch is folded: neighbouring ranges add up. A full counter bounds nothing.
        folded = np.array([counts[i].reshape(least, -1).sum(axis=1, dtype=np.int64) for i in used])
        open_ = np.array([(counts[i] == 255).any() for i in used])
        first, second = place[:len(rows)], place[len(rows):]
        for low in range(0, len(rows), 8192):
            part = slice(low, low + 8192)
            common = np.minimum(folded[first[part]], folded[second[part]]).sum(axis=1)
            out[rows[part]] = np.where(open_[first[part]] | open_[second[part]], 2 ** 40, common)
    return out


def meeting_pairs(posted: DataFrame, sketched: DataFrame, threshold: int, buckets: int) -> DataFrame:
    """Step 4, second half: pairs (a, b) of different components that meet in a prefix and are within all bounds.

    Bounds that cost nothing: the sizes, and what can follow the first common element. Pairs that pass are held
    against the ranges their elements fall into; what is left is emitted, few pairs besides those that link.
    """
    lists = (posted.groupBy("element").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("_l"),
                                           F.max("comp").alias("_h"))
             .where(F.col("_l") != F.col("_h")).drop("_l", "_h"))
    rows = posted.join(lists, "element").withColumn("tiles", F.ceil(F.col("rows") / TILE_ROWS).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # A list of one tile stays as it is; each row of a longer one goes to the tiles of its part with every part.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("element", "node", "comp", "size", "rest", "own",
                       F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                       F.when(F.col("tiles") == 1, spread("element", buckets)).otherwise(F.col("element"))
                       .cast("long").alias("bucket"))
    keys = ["bucket", "p", "q"]
    known = rows.select(*[F.col(k).alias(k) for k in keys], F.col("node").alias("node")).distinct().join(sketched, "node")

    def meet(key_: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        element = table.column("element").to_numpy()
        order = np.argsort(element, kind="stable")
        node, comp, size, rest, own = (table.column(c).to_numpy()[order]
                                       for c in ("node", "comp", "size", "rest", "own"))
        element, across = element[order], key_[1].as_py() != key_[2].as_py()
        size, rest = size.astype(np.int64), rest.astype(np.int64)
        names, number = np.unique(node, return_inverse=True)
        sizes = np.zeros(len(names), np.int64)
        sizes[number] = size
        counts: list[np.ndarray] = [None] * len(names)
        for v, data in zip(np.searchsorted(names, known.column("node").to_numpy()), known.column("counts").to_pylist(),
                           strict=True):
            counts[v] = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(np.r_[True, element[1:] != element[:-1], True]) if len(element) else np.zeros(0, np.int64)
        passed = np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def judge() -> np.ndarray:
            pair = np.setdiff1d(np.unique(np.concatenate(held)), passed)
            x, y = np.divmod(pair, len(names))
            most = overlap_bounds(counts, x, y)
            return np.union1d(passed, pair[(100 + threshold) * most >= threshold * (sizes[x] + sizes[y])])

        for low, high in zip(cuts[:-1], cuts[1:]):
            c, s, v, r, o = (a[low:high] for a in (comp, size, number, rest, own))
            for i in range(0, len(v), 256):
                part = slice(i, i + 256)
                both = s[part, None] + s
                fits = (v[part, None] < v) & (c[part, None] != c)
                fits &= (100 + threshold) * (1 + np.minimum(r[part, None], r)) >= threshold * both
                fits &= 100 * np.minimum(s[part, None], s) >= threshold * np.maximum(s[part, None], s)
                if across:
                    fits &= o[part, None] != o
                x, y = np.nonzero(fits)
                if len(x):
                    held.append(v[part][x] * len(names) + v[y])
                if sum(map(len, held)) > 2_000_000:
                    passed, held = judge(), []
        if held:
            passed = judge()
        x, y = np.divmod(passed, max(len(names), 1))
        return pa.table({"a": pa.array(names[x]), "b": pa.array(names[y])})

    return (rows.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(meet, "a long, b long")
            .distinct())


def pair_links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs that link, by the overlap of their whole sets."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    common = F.size(F.array_intersect("_x", "_y"))
    return (pairs.join(first, "a").join(second, "b")
            .where(100 * common >= threshold * (F.size("_x") + F.size("_y") - common)).select("a", "b"))


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS,
                       threshold: int = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id reachable by links, itself included."""
    spark = df.sparkSession
    rows = cut_lineage(set_rows(df, key, text, n))
    classes = (rows.where(F.col("n_shingles") > 0).groupBy("node")
               .agg(F.min("doc_id").alias("rep"), F.min("place").alias("place")))
    sets = cut_lineage(candidates(df, classes, key, text, n, threshold, chunk_bytes))
    links = cut_lineage(group_links(sets, threshold))
    comps = components(links)
    grouped = sets.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    total = sets.agg(F.sum("size")).first()[0] or 0
    chunks = max(8 * total // chunk_bytes + 1, parallelism(spark))
    posted = cut_lineage(postings(grouped, threshold, chunks))
    pairs = meeting_pairs(posted, sketches(sets), threshold, 2 * parallelism(spark))
    more = pair_links(pairs, sets, threshold)
    comps = components(links.unionByName(more))
    least = (classes.join(comps, "node").groupBy("component").agg(F.min("rep").alias("smallest")))
    whole = comps.join(least, "component").select("node", "smallest")
    named = classes.join(whole, "node", "left").select("node", F.least("rep", "smallest").alias("_c"))
    return (rows.join(named, "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_c")).alias("component_id")))
