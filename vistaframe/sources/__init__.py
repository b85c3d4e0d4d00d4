"""Readers: parquet tables, ordered line files, documents, CSV with null literals, listings, vocabularies."""
