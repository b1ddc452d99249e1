import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor

from cargolens.llm import pieces as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "\n", "a\n\nb", " ▁x▁ y", "日本語のテキスト", "😀 emoji 😀😀", "x" * 300, "ab" * 4000, "\t tab",
       "</s>[INST]", "<0x0A>", "é" * 100, "á", " " * 40 + "many", "ﬁ ① ｆ"]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("ab ▁\né日😀<s>ing the") for _ in range(rng.randrange(90))) for _ in range(300)]


def test_ids_and_spans_equal_the_library():
    mine, library = S.Encoder(MODEL), SentencePieceProcessor(model_file=MODEL)
    for text in texts():
        ids, begins, ends = mine.encode(text.encode())
        assert ids == library.encode(text, add_eos=True)
        assert library.decode(ids) == library.decode(library.encode(text))
        place = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist()))[:-1] == place


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_character_maps_equal_the_library(rule):
    library = SentencePieceNormalizer(rule_name=rule)
    model = S.model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    mine = S.Normalizer(model.normalizer_spec)
    for text in [*texts(), "Ｆｕｌｌ ①② ﬁne ÀÉ ｶﾞ  "]:
        normal, where = mine.align(text.encode())
        assert normal == library.normalize(text)
        assert len(where) == len(normal) + 1 and where == sorted(where) and where[-1] <= len(text.encode())


def test_rows_keep_columns_and_null_is_empty(make):
    df = make([(1, "the cat", 9), (2, None, 8), (2, None, 8)], "doc_id int, text string, ids int")
    encoded = S.encode_texts(df, MODEL)
    assert encoded.columns == ["doc_id", "ids", "begins", "ends"]
    got = sorted(map(tuple, S.decode_ids(encoded, MODEL).select("doc_id", "decoded").collect()))
    assert got == [(1, "the cat"), (2, ""), (2, "")]
    digests = {r.doc_id: r for r in S.digest(df, MODEL).collect()}
    assert digests[2].n_tokens == 1 and digests[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert digests[1].spanned_bytes == 7
    assert S.digest(df.limit(0), MODEL).count() == 0
