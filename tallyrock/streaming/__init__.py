"""Continuous ingestion into declared tables (an addition: the dialect itself has no streams)."""

from .ingest import ingest

__all__ = ["ingest"]
