import zlib

from cargolens.llm import sharding as H

WRAP = 1 << 64


def walk(key, shards):
    at, after, key = -1, 0, key % WRAP
    while after < shards:
        at = after
        key = (key * H.MULTIPLIER + 1) % WRAP
        after = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_walks_equal_the_published_method(spark):
    keys = [*range(300), -1, -(2 ** 63), 2 ** 63 - 1, 987654321987654321]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 9, 1000):
        got = {r.k: r.s for r in df.select("k", H.jump_hash(df.k, shards).alias("s")).collect()}
        assert got == {k: walk(k, shards) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself_and_slots_are_gapless(make):
    rows = [(i, f"text {i % 7}", i) for i in range(500)] + [(3, "twin", 0)] * 40 + [(None, None, 0), (4, "", 0)]
    df = make(rows, "doc_id long, text string, shard int")
    got = H.number_slots(H.assign_shards(df).drop("text")).collect()
    assert len(got) == len(rows)
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    one = next(r for r in got if r.doc_id == 11)
    assert (one.size, one.text_crc32, one.law) == (7, zlib.crc32(b"text 4"), "key")
    none = next(r for r in got if r.doc_id is None)
    assert (none.size, none.text_crc32) == (1, 0)
    assert H.number_slots(H.assign_shards(df.limit(0)).drop("text")).count() == 0


def test_keys_of_other_types_are_hashed(make):
    got = H.assign_shards(make([("a", "x"), ("b", None)], "doc_id string, text string")).collect()
    assert all(0 <= r.shard < 8 for r in got)
