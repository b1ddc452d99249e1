"""Periodic runs of words, found on a Re-Pair grammar of the texts.

The texts of a batch become one grammar. In each round every pair of neighbouring symbols that occurs at least twice is
counted, and an occurrence is replaced by the pair's new symbol where it is more frequent than the pairs it overlaps;
rounds go on until no pair repeats. What is left of each text is paired up evenly to a tree, so every text is one
symbol and a symbol's derivation positions are the places where it was put in.

A run that lies in the expansion of X -> Y Z and crosses the boundary has at least two periods on one side of it when it has four
in all. So for each X, once, the periods p are tried for which Z starts with two equal blocks of p words or Y ends with them
(prefix hashes, all symbols at a time); the block is extended as far as X goes. What is found is carried to
all positions of X, and of the intervals of one period those inside a larger one are dropped: the maximal run
is among them, as the smallest symbol around it yields it whole. Intervals of several periods keep the smallest.
Hashes only propose: every run of the result is compared word by word, and a text with a false one is scanned plainly.

Words stand for themselves by 64-bit hashes, compared inside one text only. The work is in proportion to n log n for a
text of n words; a task holds the words of one group of texts, of ``GROUP_WORDS`` or of a single longer text.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows are treated alike;
a null key is kept; other columns of the input are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import texts_of, word_hashes

#: A run has at least EXPONENT periods and LEAST words.
EXPONENT, LEAST = 4, 6
#: Words of the texts that share a grammar.
GROUP_WORDS = 500_000
#: Pairs of (symbol, period) that are tried at a time.
TRIED = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Order in which words are read: from a key and the number of words to word numbers, or None for the order they have.
Order = Callable[[object, int], "np.ndarray | None"]


@dataclass
class Grammar:
    """Rules by number: bounds of the first expansion, and all places (rule, start) where a rule was put in."""

    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    place: np.ndarray


def _pairs_chosen(symbol: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Positions i whose pair (i, i + 1) is replaced in this round; no two of them overlap."""
    bits = max(int(len(symbol)).bit_length() + 1, 8)
    code = (symbol[:-1].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
            + symbol[1:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    code = ((code ^ (code >> np.uint64(29))) * _BASE >> np.uint64(64 - bits)).astype(np.int64)
    count = np.bincount(code[inside], minlength=1 << bits)[code]
    rank = np.where(inside & (count > 1), (count << bits) + code, 0)
    if not rank.any():
        return np.zeros(0, np.int64)
    # Equal neighbours are one stretch of a repeated symbol: every second pair of it is taken, if it leads its neighbours.
    first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
    value = rank[first]
    lead = (value > 0) & (value > np.r_[0, value[:-1]]) & (value > np.r_[value[1:], 0])
    sizes = np.diff(np.r_[first, len(rank)])[lead]
    offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (np.repeat(first[lead], sizes) + offset)[offset % 2 == 0]


def repair_grammar(words: np.ndarray, text: np.ndarray) -> Grammar:
    """Grammar of texts laid end to end: ``text`` numbers the text of each word, ascending."""
    symbol = np.unique(words, return_inverse=True)[1].astype(np.int64)
    place, size, owner = np.arange(len(words)), np.ones(len(words), np.int64), text
    free, rules, made = int(symbol.max(initial=-1)) + 1, 0, []
    repeats = True
    while len(symbol) > 1:
        inside = owner[:-1] == owner[1:]
        if repeats:
            at = _pairs_chosen(symbol, inside)
            if not len(at):
                repeats = False
                continue
            # Codes of pairs may collide; the rule is the pair itself.
            _, first, which = np.unique(symbol[at] * free + symbol[at + 1], return_index=True, return_inverse=True)
        else:
            begin = np.flatnonzero(np.r_[True, ~inside])
            within = np.arange(len(symbol)) - np.repeat(begin, np.diff(np.r_[begin, len(symbol)]))
            at = np.flatnonzero((within[:-1] % 2 == 0) & inside)
            if not len(at):
                break
            first = which = np.arange(len(at))
        made.append((place[at][first], place[at + 1][first], place[at + 1][first] + size[at + 1][first],
                     which + rules, place[at]))
        symbol[at] = free + which
        size[at] += size[at + 1]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, place, size, owner = symbol[keep], place[keep], size[keep], owner[keep]
        free, rules = free + len(first), rules + len(first)
    return Grammar(*[np.concatenate(part) if made else np.zeros(0, np.int64)
                     for part in (zip(*made, strict=True) if made else [()] * 5)])


class _Hashes:
    """Equality of stretches of a word array by prefix sums of hash * base ** position, modulo 2 ** 64."""

    def __init__(self, words: np.ndarray) -> None:
        self.power = np.cumprod(np.full(len(words) + 1, _BASE)) * np.uint64(0x2545F4914F6CDD1D)
        self.upto = np.r_[np.zeros(1, np.uint64), np.cumsum(words * self.power[:-1])]
        self.shift = np.r_[np.ones(1, np.uint64), np.cumprod(np.full(len(words), _BASE))]

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i equal the n words from j >= i."""
        return (self.upto[i + n] - self.upto[i]) * self.shift[j - i] == self.upto[j + n] - self.upto[j]

    def extend(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far, up to ``most``, the words from i and j agree; with ``back`` those before i and j."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            n = (low + high + 1) // 2
            good = self.same(i - n, j - n, n) if back else self.same(i, j, n)
            low, high = np.where(good, n, low), np.where(good, high, n - 1)
        return low


def _tried(many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rule, period) for the periods 1..many of each rule, in parts of bounded size."""
    upto = np.cumsum(many)
    total, low = int(upto[-1]) if len(many) else 0, 0
    while low < total:
        high = min(low + TRIED, total)
        a, b = np.searchsorted(upto, low, side="right"), np.searchsorted(upto, high - 1, side="right")
        take = np.minimum(upto[a:b + 1], high) - np.maximum(upto[a:b + 1] - many[a:b + 1], low)
        rule = np.repeat(np.arange(a, b + 1), take)
        yield rule, np.arange(low, high) - (upto[rule] - many[rule]) + 1
        low = high


def boundary_runs(grammar: Grammar, words: np.ndarray, hashes: _Hashes) -> tuple[np.ndarray, ...]:
    """(rule, start in its expansion, length, period) of the runs that cross the boundary of each rule."""
    found = []
    whole = grammar.end - grammar.start
    for right in (True, False):
        side = grammar.end - grammar.middle if right else grammar.middle - grammar.start
        many = np.where(whole >= LEAST, np.minimum(side // 2, whole // EXPONENT), 0)
        for rule, period in _tried(many):
            # The words from the anchor equal those one period on, for one period at least.
            anchor = grammar.middle[rule] - (0 if right else 2 * period)
            good = words[anchor] == words[anchor + period]
            rule, period, anchor = rule[good], period[good], anchor[good]
            good = hashes.same(anchor, anchor + period, period)
            rule, period, anchor = rule[good], period[good], anchor[good]
            more = hashes.extend(anchor, anchor + period, grammar.end[rule] - period - anchor, False)
            less = hashes.extend(anchor, anchor + period, anchor - grammar.start[rule], True)
            length = less + more + period
            good = length >= np.maximum(LEAST, EXPONENT * period)
            found.append((rule[good], (anchor - less - grammar.start[rule])[good], length[good], period[good]))
    rule, start, length, period = (np.concatenate(part) if found else np.zeros(0, np.int64)
                                   for part in (zip(*found, strict=True) if found else [()] * 4))
    order = np.lexsort((period, length, start, rule))
    rule, start, length, period = rule[order], start[order], length[order], period[order]
    new = np.r_[True, (rule[1:] != rule[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(rule)]
    return rule[new], start[new], length[new], period[new]


def _derived(grammar: Grammar, rule: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray
             ) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the runs at all derivation positions of their rules."""
    known = np.unique(rule)
    mine = np.isin(grammar.rule, known)
    of, place = grammar.rule[mine], grammar.place[mine]
    order = np.argsort(of, kind="stable")
    of, place = of[order], place[order]
    low, high = np.searchsorted(of, rule), np.searchsorted(of, rule, side="right")
    many = high - low
    which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    begin = place[which] + np.repeat(start, many)
    return begin, begin + np.repeat(length, many), np.repeat(period, many)


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of a period that are not inside another of it, then the smallest period of each interval."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        reach = np.maximum.accumulate(end + period * (int(end.max()) + 1))
        outer = np.r_[True, (period[1:] != period[:-1]) | (reach[1:] > reach[:-1])]
        start, end, period = start[outer], end[outer], period[outer]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
        start, end, period = start[new], end[new], period[new]
    return start, end, period


def scanned_runs(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the runs of one text by comparing it with itself at every period."""
    out = [(np.zeros(0, np.int64),) * 3]
    for p in range(1, len(words) // EXPONENT + 1):
        edge = np.flatnonzero(np.diff(np.r_[False, words[:-p] == words[p:], False].astype(np.int8))).reshape(-1, 2)
        long_ = edge[edge[:, 1] - edge[:, 0] + p >= max(LEAST, EXPONENT * p)]
        out.append((long_[:, 0], long_[:, 1] + p, np.full(len(long_), p)))
    return _maximal(*[np.concatenate(part) for part in zip(*out, strict=True)])


def _holds(words: np.ndarray, low: int, high: int, start: int, end: int, period: int) -> bool:
    """Whether start..end is a maximal stretch of the period inside the text low..high."""
    return bool((words[start:end - period] == words[start + period:end]).all()
                and (start == low or words[start - 1] != words[start - 1 + period])
                and (end == high or words[end] != words[end - period]))


def runs_of_texts(words: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of all runs of each text, by start, then period; text i has words offsets[i]:offsets[i + 1]."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grammar = repair_grammar(words, text)
    start, end, period = _maximal(*_derived(grammar, *boundary_runs(grammar, words, _Hashes(words))))
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    cuts = np.searchsorted(start, offsets)
    none = np.zeros(0, np.int64)
    out = [(none, none, none)] * (len(offsets) - 1)
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        low, high = int(offsets[i]), int(offsets[i + 1])
        s, e, p = (v[cuts[i]:cuts[i + 1]] for v in (start, end, period))
        if not all(_holds(words, low, high, *run) for run in zip(s.tolist(), e.tolist(), p.tolist(), strict=True)):
            s, e, p = scanned_runs(words[low:high])
            order = np.lexsort((p, s))
            s, e, p = s[order] + low, e[order] + low, p[order]
        out[i] = s - low, e - s, p
    return out


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:n] > 0


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts low..high of about GROUP_WORDS words together."""
    low = 0
    while low < len(offsets) - 1:
        high = max(int(np.searchsorted(offsets, offsets[low] + GROUP_WORDS, side="right")) - 1, low + 1)
        yield low, high
        low = high


RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", order: Order | None = None) -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period) and collapsed: the words no run repeats.

    ``order`` gives the words that are read instead of a text's own, to plant repeats with a known answer.
    """
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("n_words", "long").add("runs", RUNS).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            hashes, offsets, _, _ = word_hashes(texts, lower=False)
            read: dict[int, np.ndarray] = {}
            if order is not None:
                for i, k in enumerate(batch.column(0).to_pylist()):
                    took = order(k, int(offsets[i + 1] - offsets[i]))
                    if took is not None:
                        read[i] = took
                        hashes[offsets[i]:offsets[i + 1]] = hashes[offsets[i]:offsets[i + 1]][took]
            runs, kept = [], []
            for low, high in _groups(offsets):
                here = offsets[low:high + 1] - offsets[low]
                for i, (s, n, p) in enumerate(runs_of_texts(hashes[offsets[low]:offsets[high]], here), low):
                    words = texts[i].split()
                    if i in read:
                        words = [words[j] for j in read[i].tolist()]
                    if len(s):
                        gone = dropped(len(words), s, n, p).tolist()
                        words = [w for w, g in zip(words, gone, strict=True) if not g]
                    kept.append(b" ".join(words))
                    runs.append([{"start": a, "length": b, "period": c}
                                 for a, b, c in zip(s.tolist(), n.tolist(), p.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def best_run(runs: Column) -> Column:
    """The run of greatest length / period, compared as fractions; ties: smallest start, then period; null if none."""
    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when((y > x) | (y == x) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])), b).otherwise(a)
    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the best run, and SHA-256 of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("_best", best_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
