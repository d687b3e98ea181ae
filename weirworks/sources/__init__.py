"""Readers."""

from weirworks.sources.connectors import connector, jdbc, rows
from weirworks.sources.files import by_extension, csv, json, parquet, text_documents
from weirworks.sources.incremental import Bookmark, Increment
from weirworks.sources.tables import catalog_table

__all__ = [
    "Bookmark", "Increment", "by_extension", "catalog_table", "connector", "csv", "jdbc", "json",
    "parquet", "rows", "text_documents",
]
