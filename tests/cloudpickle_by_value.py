"""Lets worker processes see a module as a test has patched it."""

from __future__ import annotations

import sys


def use(monkeypatch, module, opener):
    """Replace ``module._open`` by ``opener`` here and, as modules are then pickled by value, in the workers."""
    from pyspark import cloudpickle

    monkeypatch.setattr(module, "_open", opener)
    named = [module, sys.modules[type(opener).__module__], sys.modules["fake_containers"]]
    for m in named:
        cloudpickle.register_pickle_by_value(m)
        monkeypatch.setattr(m, "__pickled_by_value__", True, raising=False)
    return opener
