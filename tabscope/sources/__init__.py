"""Readers (CSV/TXT, JSON, Parquet) and table shape, schema and preview."""

from .readers import (NA_TOKENS, preview_head, read_table, scan_csv, scan_json, schema_table,
                      table_shape)

__all__ = ["NA_TOKENS", "preview_head", "read_table", "scan_csv", "scan_json", "schema_table",
           "table_shape"]
