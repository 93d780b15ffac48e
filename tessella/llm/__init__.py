"""Operators for training-data pipelines: filtering, scanning, deduplication and packing of documents."""
