"""Incremental paths: the append-only query log and file-by-file book ingest."""
