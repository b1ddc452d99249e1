"""Source mixing: targets, schedule and what is taken, against plain loops."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cargolens.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, size int, row int, number int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(seed, many=200):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["a", "a", "a", "a", "b", "B", "é", "\U0001f600", "￿", "", None]),
             "w " * rng.randrange(0, 90) + " ") for i in range(many)]
    docs += [(500, "a", None), (501, "zero", ""), (502, "tiny", "x"), (503, "c", "v " * 4000), (None, "a", "q r s"), (None, None, "t"),
             (7, "a", "u " * 30), docs[7], docs[7]]
    return docs


def words(text):
    return len(WORD.findall(text or ""))


def brute_targets(docs):
    size = defaultdict(int)
    for _, s, t in docs:
        size[s] += words(t)
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, Fraction(3 * sum(size.values()), 2), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * size[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = Fraction(2 * size[s])
            left -= 2 * size[s]
            open_.remove(s)
    return size, target


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_and_taken_words(make, seed):
    docs = table(seed)
    df = make([(d, s, t, 0, 0, 0) for d, s, t in docs], SCHEMA).repartition(5)
    got = M.mixed_documents(df, block=64).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), words(t)) for d, _, t in docs)
    size, target = brute_targets(docs)
    rows = M.sized_rows(df)
    found = {r.source: r for r in M.source_targets(rows, block=64).collect()}
    assert set(found) == set(size)
    for s, r in found.items():
        assert r.source_size == size[s] and abs(r.target - float(target[s])) < 1e-6
        assert abs(r.quota - r.target) <= 0.5 and r.high - r.low == -(-r.quota // 64)
    source_of = defaultdict(set)
    for d, s, _ in docs:
        source_of[d].add(s)
    assert sum(r.taken for r in got) == sum(r.quota for r in found.values())
    for s, r in found.items():
        if all(len(v) == 1 for d, v in source_of.items() if s in v):
            assert sum(g.taken for g in got if source_of[g.doc_id] == {s}) == r.quota
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = M.mixed_documents(df.repartition(2), block=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_pieces_fill_every_block_with_the_shuffled_stream(make):
    docs = [d for d in table(4) if d[0] is not None and d[0] != 7]
    df = make([(d, s, t, 0, 0, 0) for d, s, t in docs], SCHEMA).repartition(3)
    rows = M.sized_rows(df)
    targets = M.source_targets(rows, block=50)
    sources = {r.number: r for r in targets.collect()}
    slots = {r.slot: (r.number, r["rank"]) for r in M.schedule(targets, slots_a_row=7).collect()}
    total = sum(r.high - r.low for r in sources.values())
    assert len(slots) == total
    bits = max((total - 1).bit_length(), 1)
    at = 0
    seen = defaultdict(int)
    for slot in sorted(slots):  # ranks count up in the order of the slots; each slot is the reversed point of its source's interval
        number, rank = slots[slot]
        u = int(format(slot, f"0{bits}b")[::-1], 2)
        assert sources[number].low <= u < sources[number].high and rank == seen[number]
        seen[number] += 1
        at += 1
    stream = {}
    for r in sources.values():
        mine = [(d, words(t)) for d, s, t in docs if s == r.source and words(t)]
        out = []
        for turn in range(2):
            for d, n in sorted(mine, key=lambda m: (hashlib.md5(f"mix:{turn}:{m[0]}".encode()).hexdigest(), m)):
                out += [(d, i) for i in range(n)]
        stream[r.number] = out[:r.quota]
    played = defaultdict(dict)
    for p in M.mix(rows, targets, block=50).collect():
        for i in range(p.length):
            played[p.slot][p.place + i] = (p.doc_id, p.start + i)
    for slot, (number, rank) in slots.items():
        want = stream[number][rank * 50:(rank + 1) * 50]
        assert [played[slot][i] for i in range(len(want))] == want and len(played[slot]) == len(want)


def test_any_stretch_of_slots_holds_the_sources_in_nearly_their_share(make):
    targets = make([(i, low, high, 1000) for i, (low, high) in enumerate([(0, 500), (500, 510), (510, 1000)])],
                   "number int, low long, high long, blocks long")
    slots = [r.number for r in M.schedule(targets).orderBy("slot").collect()]
    for size in (50, 100, 250):
        for low in range(0, 1000 - size, size):
            part = slots[low:low + size]
            assert abs(part.count(0) - size / 2) <= 8 and abs(part.count(1) - size / 100) <= 4


def test_empty_and_wordless_tables(make):
    df = make([(1, "a", "x", 0, 0, 0)], SCHEMA)
    assert M.mixed_documents(df.limit(0)).count() == 0
    assert [tuple(r) for r in M.mixed_documents(df.withColumn("text", F.lit(" "))).collect()] == [(1, 0, 0, 0.0, 0)]
    assert [tuple(r) for r in M.mixed_documents(df).collect()] == [(1, 1, 1, 1.5, 2)]
