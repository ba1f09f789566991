"""Registered queries over the supplied tables, each with a DuckDB statement that checks it."""

import importlib

FAMILIES = ("timeseries", "eventlog", "alerts", "verdicts", "retrieval", "history", "report", "streams", "tables")


def load():
    """Import all families and return the registry."""
    for family in FAMILIES:
        importlib.import_module(f"suite.{family}")
    return importlib.import_module("suite.registry")
