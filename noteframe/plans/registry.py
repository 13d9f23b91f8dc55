"""All registered queries and their check SQL."""

from __future__ import annotations

from . import classes, clinical, documents, evaluation, files, models, tables

MODULES = (tables, clinical, documents, evaluation, classes, files, models)


def queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def oracles() -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(module.ORACLES)
    return out
