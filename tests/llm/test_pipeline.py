"""Stages of the pipeline, and the registered queries with a twin, on small tables."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from cargolens.llm import pieces, toxicity
from compare import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_registered_query_runs_and_equals_its_twin(spark, con, name):
    text, good = compare(spark, con, FOLDER, name)
    assert good, text


def test_stages_decide_on_planted_cases(spark, tmp_path):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(500)]

    def words(n):
        return [rng.choice(common) for _ in range(n)]

    passage = " ".join(words(60))
    rows = [(i, " ".join(words(80)), "en", "s", 1) for i in range(200)]
    rows += [(200 + i, " ".join([*words(60), "vile", "awful", "nasty", "vile2", *words(9)]), "en", "s", 1) for i in range(60)]
    rows += [(300, rows[3][1], "en", "s", 1), (301, rows[4][1] + " more", "en", "s", 1), (302, None, "en", "s", 1),
             (303, "", "en", "s", 1), (304, " ".join(words(50)) + " " + passage, "en", "s", 1),
             (305, passage + " " + " ".join(words(50)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(i, 0, int(200 <= i < 260)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    toxic = C.drop_toxic(spark, docs, str(tmp_path))
    kept = {r.doc_id for r in toxic.collect()}
    assert kept == {r[0] for r in rows if not 200 <= r[0] < 260}
    unique = C.drop_near_duplicates(spark, toxic, str(tmp_path))
    assert unique.columns == docs.columns
    assert kept - {r.doc_id for r in unique.collect()} == {300, 301}
    cut = {r.doc_id: r for r in C.drop_repeated_passages(spark, unique, str(tmp_path)).collect()}
    assert cut[305].text == rows[-1][1][len(passage) + 1:] and cut[305].n_chars == len(cut[305].text)
    assert cut[304].text == rows[-2][1] and cut[302].text is None and cut[304].n_chars == 1
    packed = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(cut)
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]


def test_rows_without_an_id_and_rows_of_one_id(spark):
    rng = random.Random(7)
    a, b, c, d = (" ".join(f"w{rng.randrange(500)}" for _ in range(90)) for _ in range(4))
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    rows = [(None, a, "1"), (None, a, "1"), (None, a + " more", "2"), (None, b, "3"), (5, b + " more", "4"), (7, c, "5"),
            (7, d, "6"), (8, d + " more", "7"), (7, c, "5"), (None, "", "8"), (None, "", "8"), (None, None, "9")]
    docs = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], schema).repartition(4)
    kept = sorted((r.doc_id or 0, r.lang) for r in C.drop_near_duplicates(spark, docs, "").collect())
    assert len(kept) == 7 and kept[0][1] in "12" and kept[1:] == [(0, "8"), (0, "8"), (0, "9"), (5, "4"), (7, "5"), (7, "6")]
    # Two rows of one id lose words: each row keeps its own rest.
    rows = [(1, a + " " + b, "1"), (9, a + " first end", "2"), (9, b + " second end", "3"), (None, a, "4"), (10, None, "5")]
    docs = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], schema).repartition(2)
    cut = {(r.lang, r.doc_id, r.text, r.n_chars) for r in C.drop_repeated_passages(spark, docs, "").collect()}
    assert cut == {("1", 1, rows[0][1], 1), ("2", 9, "first end", 9), ("3", 9, "second end", 10), ("4", None, a, 1),
                   ("5", 10, None, 1)}


def test_extra_columns_named_like_work_columns(spark):
    """Rows and extra columns come through whatever the extra columns are called."""
    names = ["_key", "_n", "_first", "_alone", "_row", "_text", "_TEXT_", "component_id", "n_shingles"]
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, *"abcdefghi"), (2, text, *"abcdefghi"), (3, None, *"abcdefghi")],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    unique = C.drop_near_duplicates(spark, docs, "")
    assert unique.columns == docs.columns
    assert sorted((r[0], r[1], "".join(r[2:])) for r in unique.collect()) == [(1, text, "abcdefghi"), (3, None, "abcdefghi")]
    model = toxicity.Model(np.array([], dtype=np.int64), np.array([]), 0.0)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "score", "predicted"]
    assert {(r.doc_id, r._text, r["_TEXT_"], r.score) for r in scored.collect()} == {(i, "f", "g", 0.5) for i in (1, 2, 3)}
    encoded = pieces.encode_texts(docs.drop("_TEXT_"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {(r.doc_id, r._text) for r in encoded.collect()} == {(i, "f") for i in (1, 2, 3)}
