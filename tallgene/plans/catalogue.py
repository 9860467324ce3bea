"""Collects every registered query."""

import importlib

from tallgene.plans.registry import ORACLES, QUERIES

SECTIONS = [
    "cells", "values", "names", "aggregates", "orders", "sets", "samples", "perturbations", "evaluation",
    "arrays", "training", "genome", "vectors", "stores",
]

for _name in SECTIONS:
    importlib.import_module(f"tallgene.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
