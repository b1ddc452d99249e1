"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Targets: sources in order of their name share a multiple of all words by weight; none gets more than ``most`` times what it
has, and the excess goes to the others by weight. That is one level for all sources below their limit, found from running
sums over the sources in order of limit / weight.

Schedule: a source takes its target in blocks of ``block`` words (the last may be shorter). All blocks of all sources own
the integers below M, each source an interval of the cumulative number of blocks; the point u is played at slot
rev(u), its bits reversed. So slot t shows the van der Corput point rev(t) of the cumulative weights, and any stretch of
slots holds each source in nearly its share. Slots are enumerated from the intervals, in pieces of bounded size; the rank of a slot
among those of its source has a closed form (for each set bit of u, the numbers of the interval that agree below it and are clear there), so slots are neither
sorted nor counted.

Join: the documents of a source are shuffled by digest, anew for each pass, and laid end to end; rank r takes the
words r * block and on of that stream. A document longer than a block lies in several.

Nothing is gathered by source: running sums are taken over range partitions, slots and pieces meet by (source, rank).

Defined cases: null texts have no words and are never taken; a null source is the last source; rows of equal id are rows
each; rows without an id are shuffled like one id, by size; no words at all give targets of 0; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scale import null_safe_join, ordered_running
from .shared import cut_lineage

#: Weights of the sources in order, repeating; share of all words the mix takes; most a source gives, in passes.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words of a block.
BLOCK = 1024
#: Slots that one row is enumerated to.
SLOTS_A_ROW = 65_536
#: Sources up to this number are sent to all tasks (some 100 bytes each); more are joined by shuffle.
FEW_SOURCES = 50_000
SEED = "mix"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
                   block: int = BLOCK) -> DataFrame:
    """source, number, source_size, target, quota (whole words), and the interval low..high of its blocks among all."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = ordered_running(by_source, [], [F.col("source").asc_nulls_last()], {"number": F.lit(1)},
                           {"_all": F.col("source_size")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    rows = ordered_running(rows, [], [F.col("_cap") / F.col("_w"), F.col("number")],
                           {"_caps": F.col("_cap"), "_ws": F.col("_w")}, {"_weights": F.col("_w")})
    left = F.col("_all") * F.lit(share) - (F.col("_caps") - F.col("_cap"))
    full = F.col("_cap") * (F.col("_weights") - (F.col("_ws") - F.col("_w"))) <= F.col("_w") * left
    rows = cut_lineage(rows.withColumn("_full", full))
    sums = rows.agg(F.max("_all"), F.max("_weights"), F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)),
                    F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0.0))).first()
    words, all_weights, caps, full_weights = (float(v or 0) for v in sums)
    level = (words * share - caps) / (all_weights - full_weights) if all_weights > full_weights else 0.0
    rows = (rows.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.lit(level)))
            .withColumn("quota", F.floor(F.col("target") + 0.5).cast("bigint"))
            .withColumn("_blocks", F.ceil(F.col("quota") / F.lit(block)).cast("bigint")))
    rows = ordered_running(rows.select("source", "number", "source_size", "target", "quota", "_blocks"), [], [F.col("number")],
                           {"high": F.col("_blocks")}, {"blocks": F.col("_blocks")})
    return rows.withColumn("low", F.col("high") - F.col("_blocks")).drop("_blocks")


def reversed_bits(u: str, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(u), bits, "0")), 2, 10).cast("bigint")


def rank_in_source(bits: int) -> Column:
    """How many numbers of low..high-1 have smaller reversed bits than u."""
    clear = "shiftright({} - (u & (shiftleft(1L, m) - 1L)) + shiftleft(2L, m) - 1L, m + 1)"
    return F.expr(f"""aggregate(sequence(0, {bits - 1}), 0L, (r, m) -> r + CASE WHEN (shiftright(u, m) & 1L) = 1L
        THEN {clear.format('high')} - {clear.format('low')} ELSE 0L END)""")


def schedule(targets: DataFrame, slots_a_row: int = SLOTS_A_ROW) -> DataFrame:
    """slot, number (of the source), rank: which block of which source stands at each slot."""
    total = targets.agg(F.max("blocks")).first()[0] or 0
    bits = max(int(total - 1).bit_length(), 1)
    step = F.lit(slots_a_row)
    parts = (targets.where(F.col("high") > F.col("low"))
             .select("number", "low", "high", F.explode(F.sequence("low", F.col("high") - 1, step)).alias("_from"))
             .repartition("number", "_from"))
    points = parts.select("number", "low", "high", F.explode(F.sequence("_from", F.least(F.col("_from") + step, "high") - 1)).alias("u"))
    return points.select(reversed_bits("u", bits).alias("slot"), "number", rank_in_source(bits).alias("rank"))


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    small = targets.select("source", "number", "source_size", "target", "quota")
    return null_safe_join(rows, F.broadcast(small) if small.count() <= FEW_SOURCES else small, ["source"])


def streams(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents with the words ``first``..``past`` they hold of their source's stream, as far as its quota goes."""
    each = (rows.where((F.col("size") > 0) & (F.col("quota") > 0))
            .select("row", "doc_id", "number", "size", "source_size", "quota",
                    F.explode(F.sequence(F.lit(0), F.expr("cast((quota - 1) div source_size AS int)"))).alias("turn")))
    name = F.concat_ws(":", F.lit(SEED), "turn", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    each = each.withColumn("_dealt", F.md5(name.cast("binary")))
    laid = ordered_running(each, ["number", "turn"], [F.col("_dealt"), F.col("doc_id"), F.col("size")], {"_end": F.col("size")})
    first = F.col("turn") * F.col("source_size") + F.col("_end") - F.col("size")
    return (laid.withColumn("first", first).where(F.col("first") < F.col("quota"))
            .withColumn("past", F.least(F.col("first") + F.col("size"), F.col("quota")))
            .select("row", "doc_id", "number", "turn", "first", "past"))


def sized_rows(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """row (a frozen number), doc_id, source, size: narrow, written once."""
    return cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc_id"),
                                 F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`").cast("string")).alias("size")))


def mix(rows: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, place, row, doc_id, start, length: the words start.. of a document stand at ``place`` of the slot's block."""
    laid = streams(_with_targets(rows, targets), block)
    size = F.lit(block).cast("bigint")
    pieces = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("past") - 1) / size))))
    low = F.greatest(F.col("first"), F.col("rank") * size)
    pieces = pieces.select(
        "number", "rank", "row", "doc_id", (low - F.col("rank") * size).alias("place"), (low - F.col("first")).alias("start"),
        (F.least(F.col("past"), (F.col("rank") + 1) * size) - low).alias("length"))
    # Planners take enumerated slots for as few as their sources: both joins of growing sides are told to shuffle.
    return (pieces.join(schedule(targets).hint("merge"), ["number", "rank"])
            .select("slot", "place", "row", "doc_id", "start", "length"))


def mixed_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: what the mix takes of it, all passes together."""
    rows = sized_rows(df, key, source, text)
    targets = cut_lineage(source_targets(rows, block=block))
    taken = mix(rows, targets, block).groupBy("row").agg(F.sum("length").alias("taken"))
    return (_with_targets(rows, targets).join(taken.hint("merge"), "row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))
