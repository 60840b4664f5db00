"""Scans, literal rows, exports and dumps."""

from .scan import point, scan, span, values
from .sinks import as_inserts, csv_lines, write_csv, write_json

__all__ = [n for n in dir() if not n.startswith("_")]
