"""Queries of the training-data operators over the test tables, and their oracles."""

from importlib import import_module

MODULES = ["plans_sample", "plans_spans", "plans_duplicates", "plans_questions", "plans_packing", "plans_leaks", "plans_reading"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"spanwright.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
