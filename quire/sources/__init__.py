"""Sources and sinks: driver tables, catalogue JSON, whole-text files, writers."""

from .files import content_report, path_part, read_contents
from .metadata import (catalogue_records, explode_json_array, flatten_metadata,
                       read_metadata)
from .sinks import export_csv, write_table
from .tables import TABLES, books, books_from_documents, configs, read_table

__all__ = ["TABLES", "books", "books_from_documents", "catalogue_records",
           "configs", "content_report", "explode_json_array", "export_csv", "flatten_metadata",
           "path_part", "read_contents", "read_metadata", "read_table",
           "write_table"]
