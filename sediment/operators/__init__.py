"""Operators on bytes, chunks, blocks and their tables."""
