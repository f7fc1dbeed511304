"""Composed jobs: ingest, index, search."""
