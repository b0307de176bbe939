"""The library's operators run over the star-schema test tables, with their SQL twins."""

from importlib import import_module

MODULES = ("messages", "statistics", "scoring", "training", "conversion", "streams")


def load() -> None:
    """Import the query modules, which register themselves in the catalog."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
