"""The optional part is left out when it can't be there, and never hides an error of its own."""

import builtins
import sys

import pytest

import __spark_entry__ as entry


@pytest.fixture
def fresh_imports():
    """Modules of the optional part are imported anew and put back afterwards."""
    mine = {n: m for n, m in sys.modules.items() if n.startswith("curalens.llm") or n == "corpus_pipeline"}
    for name in mine:
        del sys.modules[name]
    yield
    for name in [n for n in sys.modules if n.startswith("curalens.llm") or n == "corpus_pipeline"]:
        del sys.modules[name]
    sys.modules.update(mine)


def without(monkeypatch, lost, error):
    real = builtins.__import__

    def guarded(name, *args, **kwargs):
        if name == lost or name.startswith(lost + "."):
            raise error
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", guarded)


@pytest.mark.parametrize("lost", ["ahocorasick", "public_tokenizers", "numpy"])
def test_a_missing_package_leaves_the_other_queries(monkeypatch, fresh_imports, lost):
    without(monkeypatch, lost, ModuleNotFoundError(f"No module named {lost!r}", name=lost))
    try:
        with pytest.warns(UserWarning):
            names = set(entry.queries())
    except pytest.fail.Exception:                  # the optional part itself is absent
        names = set(entry.queries())
    assert "source_outcomes" in names and not any(n.startswith("op1_") for n in names)


def test_an_error_in_the_library_is_an_error(monkeypatch, fresh_imports):
    monkeypatch.setattr(entry, "OPTIONAL", ())
    monkeypatch.setattr(entry, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("x", name="curalens.nothing")))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
