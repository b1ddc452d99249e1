"""n-gram Jaccard join and substring dedup against brute force."""

import random
import re

import numpy as np
import pytest

from cargolens.llm import components as G, jaccard as J, shared, substrings as S

SCHEMA = "doc_id long, text string, chunk int, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute_components(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))] for _ in range(4)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    docs = []
    for _ in range(60):  # a group of near copies, near the threshold on both sides
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append(" ".join(words))
    for _ in range(70):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.6:
            words += rng.choice(passages)
        docs.append(" ".join(words))
        if rng.random() < 0.3:
            docs.append(" ".join(words).upper() if rng.random() < 0.5 else " \t".join(words))
    docs += ["", None, "  ", "one", "One", "a b c d", "a b c", " x ", "É é a b c", "é é a b c"] + [" ".join(passages[0])] * 30
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(make, seed):
    docs = corpus(seed)
    df = make([(i, t, 0, "x") for i, t in docs], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, chunk_bytes=4000).collect()}
    assert got == brute_components(docs)


def test_split_groups_and_tiles_lose_nothing(make, monkeypatch):
    monkeypatch.setattr(J, "TILE_ROWS", 8)
    docs = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           J.jaccard_components(make([(i, t, 0, "x") for i, t in docs], SCHEMA), chunk_bytes=4000).collect()}
    assert got == brute_components(docs)


def test_null_ids_copies_and_empty_tables(make):
    text = "one two three four five six"
    df = make([(7, text, 0, ""), (7, text, 0, ""), (None, text, 0, ""), (None, None, 0, ""), (9, "", 0, "")], SCHEMA)
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (0, 2, 7), (0, 0, None), (9, 0, 9)], key=str)
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_bounds_never_fall_below_the_overlap():
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 2, 3, 9, 30, 100, 130, 500):
        sets += [np.unique(rng.integers(0, 2 ** 63, n, dtype=np.int64) * 2 + 1)]
        sets += [np.unique(np.r_[sets[-1][: n - n // 6], rng.integers(-2 ** 63, 2 ** 63 - 1, n // 6, dtype=np.int64)])]
    counts = []
    for v in sets:
        bits = max(len(v) - 1, 1).bit_length()
        counts.append(np.bincount(v.view(np.uint64) >> np.uint64(64 - bits), minlength=1 << bits).astype(np.uint8))
    x, y = np.divmod(np.arange(len(sets) ** 2), len(sets))
    true = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert (J.overlap_bounds(counts, x, y) >= true).all()
    assert (J.overlaps(sets)[x, y] == true)[x != y].all()


def test_components_of_chains_and_stars(make):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (30, 2)]
    got = {r.node: r.component for r in G.components(make(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert G.components(make([], "a long, b long")).count() == 0


def brute_windows(docs, n=13):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i:i + n]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone |= set(range(i, i + n))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_removed_windows_equal_brute_force(make, seed):
    docs = corpus(seed)
    df = make([(i, t, 0, "x") for i, t in docs], SCHEMA).repartition(3)
    got = S.removed_spans(df, chunk_bytes=3000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_windows(docs)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert all(a[1] < b[0] for a, b in zip(r.spans, r.spans[1:]))


def test_equal_and_null_ids_repeat_nothing(make):
    text = " ".join(f"v{i}" for i in range(20))
    df = make([(4, text, 0, ""), (4, text, 0, ""), (None, text, 0, ""), (8, text + " end", 0, "")], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in S.removed_spans(df).collect())
    assert got == [(0, 0, text), (4, 0, text), (4, 0, text), (8, 20, "end")]
    assert S.digest(S.removed_spans(df.limit(0))).count() == 0


def test_words_of_many_texts_at_once():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x0c\x1c 日") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["", "x" * 1000, "x" * 999 + "y", "\0", "\0\0"]
    hashes, offsets, starts, ends = shared.word_hashes([t.encode() for t in texts], lower=False)
    joined = " ".join(texts).encode()
    seen = {}
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        assert [joined[a:b].decode() for a, b in zip(starts[offsets[i]:offsets[i + 1]], ends[offsets[i]:offsets[i + 1]])] == words
        for w, h in zip(words, hashes[offsets[i]:offsets[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
