"""Registered queries, one module per area."""

import importlib

MODULES = ("sources", "classify", "filters", "joins", "aggregates", "windows", "ranking", "sets", "scalars", "methods", "scoring", "policy", "outlook", "reports", "quality", "live", "learned")


def load_all():
    for m in MODULES:
        importlib.import_module(f"tallyloom.plans.{m}")
    return importlib.import_module("tallyloom.plans.registry")
