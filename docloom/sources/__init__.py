"""Readers of tables, pages, Markdown folders and URL lists, and the writers that go with them."""

from docloom.sources.tables import table

__all__ = ["table"]
