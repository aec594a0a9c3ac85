"""All registered queries of the text operators."""
import importlib

from routekit.llm.common import ORACLES, QUERIES

MODULES = ["simhash", "decontaminate", "classes", "quality", "licences", "substrings", "lines", "secrets", "pieces", "warc", "mixing", "whitening", "prefixes"]

for _name in MODULES:
    importlib.import_module(f"routekit.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
