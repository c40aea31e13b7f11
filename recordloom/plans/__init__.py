"""All runnable queries; importing the package registers them."""

from importlib import import_module

from recordloom.plans.registry import ORACLES, QUERIES

for _family in ("ingestion", "landed", "cleaning", "joining", "profiling", "association", "trending", "reports"):
    import_module(f"recordloom.plans.{_family}")

__all__ = ["ORACLES", "QUERIES"]
