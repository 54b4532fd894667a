"""Readers: tables, digests, archives, page folders, NDJSON."""

from tidemark.sources.tables import load

__all__ = ["load"]
