import numpy as np
import pytest

from cargolens.llm import permutation as P, topk as K

SCHEMA = "vec_id long, embedding array<double>, score int"


def rows(n=400, d=12, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[40:160] = x[0] + rng.normal(scale=0.01, size=(120, d))  # a hot direction
    x[200:230] = x[7]  # copies
    return x


ODD = [(900, None, 0), (901, [], 0), (902, [1.0, None], 0), (903, [float("nan")] * 12, 0), (904, [float("inf")] * 12, 0),
       (None, [1.0] * 12, 0)]


def test_exact_lists_equal_brute_force_with_ties_copies_and_repeated_rows(make):
    x = rows()
    table = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = make(table + [table[10], table[205]] + ODD + [(905, [1.0, 2.0], 0), (1000, [3.0, 1.0], 0)], SCHEMA).repartition(5)
    q = np.floor(1024 * x).astype(int)
    score = q @ q.T
    got = {}
    for r in K.exact_top_k(df, k=10, every=20, block_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for i in range(0, len(x), 20):
        best = sorted(((-score[i, j], j) for j in range(len(x)) if j != i))[:10]
        assert got[i] == [(j, -s) for s, j in best]
    assert got[1000] == [(905, 3072 * 1024 + 1024 * 2048)]  # the only one of its length
    assert set(got) == {*range(0, 400, 20), 1000}


def test_few_candidates_give_short_lists_and_none_no_rows(make):
    df = make([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0)], SCHEMA)
    assert [tuple(r) for r in K.exact_top_k(df, every=100).collect()] == [(0, 1, 1, 1024 * 512)]
    assert K.exact_top_k(df.limit(0)).count() == 0 and P.nearest_neighbours(df.limit(0)).count() == 0


def test_scores_beyond_doubles_stay_exact(make):
    big = float(2 ** 20 + 1)
    df = make([(0, [big, 1.0], 0), (1, [big, 3.0], 0)], SCHEMA)
    want = (int(big) * 1024) ** 2 + 3 * 1024 * 1024
    assert K.exact_top_k(df, every=100).first().score == want


def test_permutation_index_recall_and_scores(make):
    x = rows(3000, 16, 5)
    df = make([(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD + [(950, [0.0] * 16, 0)], SCHEMA)
    got = P.nearest_neighbours(df, k=20, every=50).collect()
    ids = np.array([i for i in range(3000) if i not in {r[0] for r in ODD} | {950}] + [950])
    hit = n = 0
    for i in range(0, 3000, 50):
        found = sorted(((r.rank, r.vec_id, r.score) for r in got if r.query_id == i))
        if i == 900 or i == 950:
            continue
        s = x @ x[i]
        best = sorted((j for j in range(3000) if j != i), key=lambda j: (-s[j], j))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(np.isclose(s[j], v) for _, j, v in found)
        hit += len(set(best) & {j for _, j, _ in found})
        n += 20
    assert hit / n >= 0.9 and len(ids)


@pytest.mark.parametrize("sigma", [0.5, 1.0, 2.0])
def test_recall_does_not_fall_with_the_spread_of_norms(make, sigma):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    x *= np.exp(sigma * rng.normal(size=(6000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    got = P.nearest_neighbours(make([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), every=100,
                               block_rows=10_000).collect()
    hit = 0
    for i in range(0, 6000, 100):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in got if r.query_id == i})
    assert hit / (60 * 20) >= 0.95


def test_inverted_file_counts_footrule():
    rng = np.random.default_rng(0)
    lists = np.array([rng.permutation(30)[:8] for _ in range(50)])
    index = P.InvertedFile(lists, 30)
    query = rng.permutation(30)[:8]

    def footrule(a, b):
        where = [{p: i for i, p in enumerate(v)} for v in (a, b)]
        return sum(abs(where[0].get(p, 8) - where[1].get(p, 8)) for p in set(a) | set(b))

    far = 2 * sum(range(1, 9))
    assert [far - 2 * c for c in index.closeness(query)] == [footrule(query, row) for row in lists]


def lying(kind, n=16_000):
    rng = np.random.default_rng(11)
    noise = rng.normal(size=(n, 256 if kind == "wide" else 64))
    if kind == "common mean":
        noise = 1 + 0.6 * noise
    if kind in ("40 clusters", "three tight clusters"):
        many, width = (40, 0.5) if kind == "40 clusters" else (3, 0.05)
        noise = rng.normal(size=(many, 64))[rng.integers(0, many, n)] + width * noise
    return noise / np.linalg.norm(noise, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["random", "40 clusters", "common mean", "three tight clusters", "wide"])
def test_recall_does_not_depend_on_how_vectors_lie(kind):
    x = lying(kind)
    frame = P.spread_out(x[:1024], P.PIVOTS)
    assert len(frame.pivots) == P.PIVOTS
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 200)
    hit = 0
    for q, found, scores in P.search_block(asked, x[asked], ids, x, frame, 20, P.NEAREST, P.LEAST):
        s = x @ x[q]
        s[q] = -np.inf
        assert np.allclose(scores, s[found])
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(found.tolist()))
    assert hit / (20 * len(asked)) >= 0.95


def test_ties_at_the_border_are_reranked():
    x = np.repeat(np.eye(8), 400, axis=0)
    frame = P.spread_out(x[::7], P.PIVOTS)
    (_, found, scores), = P.search_block(np.array([9999]), x[:1], np.arange(len(x)), x, frame, 20, P.NEAREST, P.LEAST)
    assert found.tolist() == list(range(20)) and (scores == 1).all()
