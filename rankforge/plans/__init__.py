"""Composed jobs and the registered queries."""

from importlib import import_module

CATALOGS = ["sources", "cleaning", "peptides", "structures", "generation", "scoring", "similarity", "training", "models"]



def load_catalog() -> None:
    """Import every module that registers queries."""
    for name in CATALOGS:
        import_module(f"rankforge.plans.catalog_{name}")
