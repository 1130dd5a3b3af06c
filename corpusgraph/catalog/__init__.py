"""Named queries. ``load_all`` imports every module that registers some."""

from importlib import import_module

MODULES = ["paths", "text", "extraction", "graphs", "contexts", "changes", "scenes", "streams"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"corpusgraph.catalog.{name}")
