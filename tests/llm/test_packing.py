import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cargolens.llm import packing as K

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World! it's 2024...", "a b\x85c", "É é é", "<|endoftext|> <|ENDOFTEXT|> x", "日本 語",
         "one " * 50, "x" * 500, "don't ), (. !?", "\x1c\x1d tab\tnew\nline"]


def check(counts, plan, capacity, documents, attention):
    bins = {}
    placed = {}
    for length, rank, first, each, offset in zip(plan.length, plan.rank, plan.first, plan.each, plan.offset):
        total = sum(1 for _ in ())
        end = min((r for n, r in zip(plan.length, plan.rank) if n == length and r > rank), default=counts[length])
        for i in range(end - rank):
            bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
            placed[length] = placed.get(length, 0) + 1
        assert total == 0
    assert placed == counts and len(bins) == plan.sequences
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and len(pieces) <= documents and sum(n * n for _, n in pieces) <= attention


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(50, 50, 2500), (50, 3, 2500), (50, 50, 900)])
def test_plans_respect_every_capacity(rule, limits):
    rng = random.Random(7)
    for _ in range(15):
        top = int(limits[2] ** 0.5)
        counts = {rng.randrange(1, min(limits[0], top) + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 25))}
        check(counts, K.best_fit_plan(counts, *limits, weights=(1.0, 0.3, 0.3), rule=rule), *limits)


def test_best_fit_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5, 1, 20_000).astype(int) + 1, 2048)
    counts = dict(zip(*(v.tolist() for v in np.unique(lengths, return_counts=True))))
    plan = K.best_fit_plan(counts, 2048, 2048, 2048 ** 2)
    assert plan.sequences <= -(-int(lengths.sum()) // 2048) * 1.002 + 1


def test_ids_equal_the_library_and_pieces_fill_sequences_without_gaps(make):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["the", "Cat,", "sat.", "é", "12"]) for _ in range(rng.randrange(120))) for _ in range(80)]
    df = make([(i, t, 1) for i, t in enumerate(texts)] + [(0, "", 1), (None, "x", 1)], "doc_id long, text string, piece int")
    tokenizer = Tokenizer.from_file(WORDS)
    pieces = K.token_pieces(df, WORDS, 32, with_ids=True)
    want = []
    for i, t in [*enumerate(texts), (0, ""), (None, "x")]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, low in enumerate(range(0, len(ids), 32)):
            part = np.array(ids[low:low + 32], "<u4").tobytes()
            want.append((i, n, low, len(part) // 4, zlib.crc32(part)))
    packed = K.pack(pieces, 32)
    got = packed.collect()
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 32
    whole = {r.sequence_id: r.ids for r in K.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in got)
    assert all(whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids for r in got)
    assert K.pack(K.token_pieces(df.limit(0), WORDS, 32), 32).count() == 0


@pytest.mark.parametrize("limits", [(50, 50, 2500), (50, 4, 2500), (50, 50, 1200)])
def test_bins_are_those_of_a_loop_over_pieces(limits):
    """Best fit one piece at a time, longest first, by the least weighted norm of what would remain."""
    rng = random.Random(3)
    scale = np.sqrt(np.array(K.WEIGHTS)) / np.array(limits)
    for _ in range(20):
        counts = {rng.randrange(1, 34): rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))}
        rooms, held = [], []
        for length in sorted(counts, reverse=True):
            demand = np.array([length, 1, length * length])
            for _ in range(counts[length]):
                fits = [i for i, room in enumerate(rooms) if (room >= demand).all()]
                if not fits:
                    rooms.append(np.array(limits))
                    held.append([])
                    fits = [len(rooms) - 1]
                at = min(fits, key=lambda i: (((rooms[i] - demand) * scale) ** 2).sum())
                rooms[at] = rooms[at] - demand
                held[at].append(length)
        plan, bins = K.best_fit_plan(counts, *limits), {}
        for length, rank, first, each in zip(plan.length, plan.rank, plan.first, plan.each):
            end = min((r for n, r in zip(plan.length, plan.rank) if n == length and r > rank), default=counts[length])
            for i in range(end - rank):
                bins.setdefault(first + i // each, []).append(length)
        assert sorted(sorted(v) for v in bins.values()) == sorted(sorted(v) for v in held)


def test_long_words_are_not_remembered():
    words = K.WordIds(WORDS)
    texts = [b"short " + b"x" * 500, b"short " + b"x" * 500 + b" " + b"x" * 500]
    tokenizer = Tokenizer.from_file(WORDS)
    for data, text in zip(words.encode(texts), texts, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text.decode(), add_special_tokens=False).ids + [0]
    assert set(words.known) == {b"short"}


def test_words_encoded_together_have_their_own_ids():
    rng = random.Random(8)
    odd = ["<|endoftext|>", "<|ENDOFTEXT|>", "\u0301a", "e\u0301", "\u1100\u1161", "\u00a0x", "a\u2003b", "\x85", "\x1c", "\ufffd", "'s", "'S", "don't",
           "\U0001f600", "\u0130", "\u00df", "1", "12", "a1'll", "<|x|>", "\u200d", "\ufb01", "\u2126", "K", "...", "\u0308", "\u093f"]
    tokenizer, words = Tokenizer.from_file(WORDS), K.WordIds(WORDS)
    for _ in range(200):
        made = list({"".join(rng.choice(odd + list("abcXYZ09.,'<|>")) for _ in range(rng.randrange(1, 6))) for _ in range(30)})
        got = words.of_words(made)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(w, add_special_tokens=False).ids for w in made]
