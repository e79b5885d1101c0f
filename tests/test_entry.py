"""The label queries are registered whatever the part on training text lacks."""

import importlib
import sys
import warnings

import pytest

import __spark_entry__ as entry
from workload import ORACLES, QUERIES


@pytest.mark.parametrize("gone", ["packwise.llm", "corpus_pipeline", "zstandard", "tokenizers", "public_tokenizers"])
def test_label_queries_without(gone, monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == gone or name.startswith(f"{gone}."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return None

    for name in list(sys.modules):
        if name.split(".")[0] in ("corpus_pipeline", gone) or name.startswith(("packwise.llm", gone)):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    monkeypatch.delattr(sys.modules["packwise"], "llm", raising=False)
    module = importlib.reload(entry)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert set(module.queries()) == set(QUERIES) and module.oracle_sql() == ORACLES


def test_a_broken_module_of_the_package_is_no_missing_library(monkeypatch):
    """Anything else than a missing import is an error of its own."""
    class Broken:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline":
                raise SyntaxError("broken")
            return None

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Broken(), *sys.meta_path])
    with pytest.raises(SyntaxError):
        entry.queries()
