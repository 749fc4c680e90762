from .readers import SourceError, open_source, sniff

__all__ = ["SourceError", "open_source", "sniff"]
