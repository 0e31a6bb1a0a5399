"""Sources and sinks: file formats, JDBC / SQLite, file inventories and
option builders for the network connectors."""

from tessera.sources.files import read_csv, read_json, read_parquet, load_source, table

__all__ = ["read_csv", "read_json", "read_parquet", "load_source", "table"]
