"""Queries of the training-data operators over the test tables, and their SQL: one module for each."""

import importlib
import pkgutil

QUERIES: dict = {}
ORACLES: dict = {}
for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    _found = importlib.import_module(f"{__name__}.{_module}")
    QUERIES.update(_found.QUERIES)
    ORACLES.update(_found.ORACLES)
