"""Registered queries over the driver tables, with the SQL each one must equal."""
import importlib

MODULES = ["scalars", "quality", "geometry", "sequence", "matching", "graph", "placement"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"routekit.plans.{name}")
