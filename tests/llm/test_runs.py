"""Runs against a comparison of every text with itself at every distance."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cargolens.llm import runs as R
from cargolens.llm.queries import echoed
from cargolens.llm.shared import word_hashes

SCHEMA = "doc_id long, text string, n_runs int, runs int, _text string"


def brute(words):
    best = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                best.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in best.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, many=40):
    rng = random.Random(seed)
    out = []
    for _ in range(many):
        k = rng.choice([1, 2, 3, 5, 30])
        w = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            a, p = rng.randrange(len(w) + 1), rng.randrange(1, 14)
            w = w[:a] + w[a:a + p] * rng.randrange(1, 10) + w[a + p:]
        out.append(w)
        if rng.random() < 0.3:
            out.append(list(w))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_the_comparison_at_every_distance(seed):
    docs = texts(seed)
    hashes, offsets, _, _ = word_hashes([" ".join(d).encode() for d in docs], False)
    for words, (s, n, p) in zip(docs, R.runs_of_texts(hashes, offsets), strict=True):
        assert list(zip(s.tolist(), n.tolist(), p.tolist())) == brute(words)
        plain = R.scanned_runs(np.array([hash(w) for w in words]))
        assert sorted((int(a), int(b - a), int(q)) for a, b, q in zip(*plain)) == brute(words)


def test_grammar_derives_the_texts():
    docs = texts(99)
    hashes, offsets, _, _ = word_hashes([" ".join(d).encode() for d in docs], False)
    owner = np.repeat(np.arange(len(docs)), np.diff(offsets))
    g = R.repair_grammar(hashes, owner)
    for rule, place in zip(g.rule.tolist(), g.place.tolist()):  # every place holds the expansion, inside one text
        size = g.end[rule] - g.start[rule]
        assert (hashes[place:place + size] == hashes[g.start[rule]:g.end[rule]]).all()
        assert owner[place] == owner[place + size - 1]
    assert len(g.start) < len(hashes)
    whole = {(int(p), int(g.end[r] - g.start[r])) for r, p in zip(g.rule, g.place)}
    assert all((int(a), int(b - a)) in whole for a, b in zip(offsets[:-1], offsets[1:]) if b - a > 1)


def test_strings_that_fool_polynomial_hashes_are_told_apart():
    """Thue-Morse words of 2**12 have equal prefix-sum hashes with their complement; results are compared word by word."""
    t = [0]
    while len(t) < 4096:
        t += [1 - x for x in t]
    words = np.array((t + [1 - x for x in t]) * 2 + [5], dtype=np.uint64)
    (s, n, p), = R.runs_of_texts(words, np.array([0, len(words)]))
    a, b, q = R.scanned_runs(words)
    assert list(zip(s.tolist(), n.tolist(), p.tolist())) == sorted((int(x), int(y - x), int(z)) for x, y, z in zip(a, b, q))


def test_one_long_text_of_one_word_is_one_run():
    words = np.full(300_000, 7, dtype=np.uint64)
    (s, n, p), = R.runs_of_texts(words, np.array([0, len(words)]))
    assert (s.tolist(), n.tolist(), p.tolist()) == ([0], [300_000], [1])


def test_table_with_nulls_copies_and_planted_repeats(make):
    docs = [(i, " ".join(w)) for i, w in enumerate(texts(5))]
    docs += [(900, None), (901, ""), (902, " \t\n"), (None, "a b " * 9), (3, docs[3][1]), (904, " x " * 8)]
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs)
    df = make([(d, t, 0, 0, "x") for d, t in docs], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in R.digest(R.periodic_runs(df, order=echoed)).collect()), key=str)
    want = []
    for d, t in docs:
        words = [w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        check = zlib.crc32(str(d).encode())
        if d is not None and check % 10 == 0 and words:
            g, n = check // 10, len(words)
            a = g % n
            q = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % q] for i in range(a, n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert R.periodic_runs(df.limit(0)).count() == 0
