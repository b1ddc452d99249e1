"""The entry point without the training-data part."""

import builtins
import sys

import __spark_entry__ as entry
from cargolens.plans import QUERIES


def test_a_missing_package_leaves_the_other_queries(monkeypatch):
    plain = builtins.__import__

    def without(name, *args, **kwargs):
        if name.split(".")[0] in ("sentencepiece", "public_tokenizers"):
            raise ModuleNotFoundError(f"No module named {name!r}")
        return plain(name, *args, **kwargs)

    for name in [n for n in sys.modules if n.startswith(("cargolens.llm", "corpus_pipeline", "sentencepiece", "public_tokenizers"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(QUERIES)
