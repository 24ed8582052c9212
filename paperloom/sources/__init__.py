"""Readers for the library's tables and for files."""

from .tables import read_table

__all__ = ["read_table"]
