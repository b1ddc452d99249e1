"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cargolens.llm import lexical as L

DOCS = "doc_id long, text string, score int, _text string, item_id long"
ITEMS = "item_id long, text string, doc_id int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts in held:
            score = 0
            for t in terms(text):
                if t in counts:
                    m = 25 + (75 * sum(counts.values()) * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10 ** 9 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["Été", "ÉTÉ", "naïve-x", "a_b", "Don't", "日本", "tab\tx", "KK"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,;"), (n + 3, docs[5][1]), (n + 4, docs[5][1]), (None, docs[5][1]),
             (7, "w149 w149"), (7, "w148"), (n + 5, "w3 " * 5000)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 30)))) for i in range(12)]
    return docs, items + [(20, None), (21, ""), (22, "nowhere"), (23, docs[5][1]), (23, "w149 W149, w149")]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_scores_of_all_documents(make, seed):
    docs, items = corpus(seed)
    df = make([(d, t, 0, "x", 1) for d, t in docs], DOCS).repartition(7)
    got = L.ranked_search(df, make([(i, t, 0) for i, t in items], ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_blocks_of_queries_and_levels_of_lists_change_nothing(make, monkeypatch):
    docs, items = corpus(3)
    df = make([(d, t, 0, "x", 1) for d, t in docs], DOCS).repartition(9)
    monkeypatch.setattr(L, "FAN_IN", 2)
    got = L.ranked_search(df, make([(i, t, 0) for i, t in items], ITEMS), k=3, query_bytes=300)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 3)


def test_empty_tables(make):
    docs, items = make([(1, "a b", 0, "x", 1)], DOCS), make([(1, "a", 0)], ITEMS)
    assert L.ranked_search(docs.limit(0), items).count() == 0
    assert L.ranked_search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in L.ranked_search(docs, items).collect()] == brute([(1, "a b")], [(1, "a")])


def file_of(docs):
    texts = [t.encode() for t in docs]
    queries = L.read_queries(texts)
    hashes, offsets = L.term_hashes(texts)
    at = np.searchsorted(queries.vocabulary, hashes)
    n = np.diff(offsets)
    code, tf = np.unique(at * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    term, doc = np.divmod(code, len(n))
    which, size = np.unique(term, return_counts=True)
    row = {k: v.astype("<i8").tobytes() for k, v in dict(n=n, term=which, size=size, doc=doc, tf=tf).items()}
    return L.File({**row, "ids": list(range(len(n)))}, len(n), int(n.sum())), queries


def test_accumulators_are_limited_and_survivors_exact():
    """Rare terms settle the ten best: the documents of the common term get no accumulator."""
    docs = ["rare " * 3 + "common"] * 12 + ["common"] * 500
    file, queries = file_of(docs)
    df = np.array([12, 512] if queries.terms[0][0] == np.searchsorted(queries.vocabulary, L.term_hashes([b"rare"])[0][0]) else [512, 12])
    order = np.argsort(df)
    weight = L.term_weights(df, len(docs))
    weight = np.maximum(weight, 1)
    found, scores, opened = L.search_file(file, order, weight[order], 10)
    assert opened == 12 and found.tolist() == list(range(10))
    whole = L.search_file(file, order, weight[order], 512)
    assert whole[2] == 512 and whole[1][:10].tolist() == scores.tolist()


def test_length_weights_beyond_64_bits_are_whole_numbers():
    n = np.array([3, 10 ** 9])
    assert L.length_weights(n, 10 ** 12, 10 ** 15).tolist() == [25 + 75 * 3 * 10 ** 12 // 10 ** 15, 25 + 75 * 10 ** 9 * 10 ** 12 // 10 ** 15]
