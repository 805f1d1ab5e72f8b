"""Sources and sinks: file trees, archives, and the tables of an archive."""

from .container import blocks, chunks, entries, extract, header, register, verify, write_archive
from .tree import scan

__all__ = ["blocks", "chunks", "entries", "extract", "header", "register", "scan", "verify", "write_archive"]
