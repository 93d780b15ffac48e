"""Imports every module that registers queries."""

from tessella.plans import (  # noqa: F401
    document_queries,
    gate_queries,
    quality_queries,
    raster_queries,
    scalar_queries,
    source_queries,
    stream_queries,
    stroke_queries,
    tree_queries,
    views,
)
