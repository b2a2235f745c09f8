"""Bound queries and end-to-end jobs."""

import importlib

GROUPS = ["volume", "text", "store", "relational", "scoring", "models", "stories", "feeds", "streams"]


def load_checks() -> dict:
    """Import every query group and return the registry."""
    from riskfabric.plans import bindings  # noqa: F401  (defines the bound views first)
    from riskfabric.plans.catalog import CHECKS
    for group in GROUPS:
        importlib.import_module(f"riskfabric.plans.checks_{group}")
    return CHECKS
