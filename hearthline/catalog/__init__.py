"""The registered queries, by area."""

from importlib import import_module
from pkgutil import iter_modules


def load_registry():
    from hearthline.catalog.registry import REGISTRY

    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
    return REGISTRY
