"""Operators for training-data corpora, one module per operator; nothing else in the library imports this package.

`load()` imports every operator module and returns (queries, statements). The modules register their
query themselves, so a new operator needs no list here.
"""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from .common import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
