"""Incremental ingest of files."""

from .ingest import ingest, running_content_id

__all__ = ["ingest", "running_content_id"]
