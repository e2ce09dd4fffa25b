"""Every named query. Importing this package fills the registry."""

from importlib import import_module

MODULES = ("gold", "validation", "loads", "quality", "series", "health", "compare", "logs", "incidents", "streams", "products")

for _module in MODULES:
    import_module(f"{__name__}.{_module}")
