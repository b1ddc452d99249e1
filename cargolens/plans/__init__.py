"""Importing the package fills the registry."""

import importlib

from .registry import QUERIES, full_sql, publish  # noqa: F401

for _family in ("warehouse", "demand", "contracts", "delivery", "location", "segments", "verify"):
    importlib.import_module(f"{__name__}.{_family}")
