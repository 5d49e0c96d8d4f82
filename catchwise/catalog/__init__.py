"""All registered queries and their SQL twins."""

from importlib import import_module

from catchwise.catalog.base import ORACLES, QUERIES

MODULES = ["network", "response", "streamflow", "cells", "space", "exchange", "plans"]

for _m in MODULES:
    import_module(f"catchwise.catalog.{_m}")


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
