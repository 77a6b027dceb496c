"""Named queries over the driver tables, grouped like the operator inventory."""

import importlib
import pkgutil


def load():
    """(queries, sql twins) of every catalog module."""
    from . import registry

    for m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if m != "registry":
            importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLES
