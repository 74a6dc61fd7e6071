"""Readers, writers and derived fixture views."""

from tillroll.sources.tables import TABLES, read_table, table_path  # noqa: F401
