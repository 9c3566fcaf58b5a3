"""Registered queries: each one a Spark plan, most with SQL that must give the same rows."""

from importlib import import_module

MODULES = (
    "window_queries",
    "source_queries",
    "split_queries",
    "vocab_queries",
    "model_queries",
    "detector_queries",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"logloom.plans.{name}")
