from . import conformance, discovery, filters, objects, windows

__all__ = ["conformance", "discovery", "filters", "objects", "windows"]
