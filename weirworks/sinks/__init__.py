"""Writers."""

from weirworks.sinks.writers import Receipt, spigot, write_catalog, write_connector, write_files, write_jdbc, write_with_receipt

__all__ = ["Receipt", "spigot", "write_catalog", "write_connector", "write_files", "write_jdbc", "write_with_receipt"]
