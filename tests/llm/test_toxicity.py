import random
import zlib

import numpy as np

from cargolens.llm import toxicity as X


def corpus(n=900):
    rng = random.Random(2)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 200))]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(3, 9) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["Vile", "awful,", "nasty."])
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(make):
    rows, labels = corpus()
    docs = make(rows, "doc_id long, text string, score double")
    model = X.fit(docs, make(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r.doc_id for r in docs.where(X.remainder("doc_id") == 1).collect()} == set(held)
    right = sum(got[i].predicted == labels[i][1] for i in held)
    assert right / len(held) > 0.97
    assert len(model.places) < 400


def test_places_equal_those_of_each_text_alone():
    texts = [b"One two, three", b"", b"one two three four", b"x"]
    owner, place = X.features(texts)
    for i, t in enumerate(texts):
        _, alone = X.features([t])
        assert sorted(place[owner == i]) == sorted(alone)
    assert sorted(X.features([b"One two, three"])[1]) == sorted(X.features([b"one TWO three."])[1])
    assert len(X.features([b"a b c d"])[1]) == 4 + 3 + 2


def test_learning_equals_the_coordinate_rule():
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.3), np.unique(rng.integers(0, 30, 6))) for _ in range(60)]
    model = X.learn(rows, alpha=0.5, beta=1.0, l1=0.2, l2=0.1, passes=2)
    z, n, w = [dict.fromkeys([*range(30), "bias"], 0.0) for _ in range(3)]

    def weight(j):
        bound = 0.0 if j == "bias" else 0.2
        return 0.0 if abs(z[j]) <= bound else (np.sign(z[j]) * bound - z[j]) / ((1.0 + n[j] ** 0.5) / 0.5 + 0.1)

    for _ in range(2):
        for y, places in rows:
            keys = [*places.tolist(), "bias"]
            w = {j: weight(j) for j in keys}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for j in keys:
                s = ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / 0.5
                z[j] += g - s * w[j]
                n[j] += g * g
    got = dict(zip(model.places.tolist(), model.weights.tolist()))
    assert all(np.isclose(got.get(j, 0.0), weight(j)) for j in range(30))
    assert np.isclose(model.intercept, weight("bias"))


def test_nulls_no_labels_and_empty_tables(make):
    docs = make([(1, None, 0), (None, "", 0), (2, "a", 0), (2, "a", 0)], "doc_id long, text string, predicted int")
    none = X.fit(docs, make([(1, None), (None, 1)], "doc_id long, toxic int"))
    got = X.score(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    seen = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 3 != 1)
    some = make([(seen, "a", 0), (seen, "a", 0)], "doc_id long, text string, predicted int")
    twice = X.fit(some, make([(seen, 1), (seen, 0), (3, 1)], "doc_id long, toxic int"))
    assert twice.intercept > 0
    assert X.score(docs.limit(0), none).count() == 0
    assert X.fit(docs.limit(0), make([(2, 1)], "doc_id long, toxic int")).intercept == 0
