"""Brush presets: a small dimension table, joined by broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRESET_SCHEMA = (
    "brush string, tip string, spacing double, "
    "size_min double, size_max double, size_gamma double, "
    "alpha_min double, alpha_max double, alpha_gamma double, "
    "velocity_to_size double, tilt_to_size double, "
    "jitter_pos double, jitter_size double, jitter_angle double, "
    "blend string, flow double, opacity double, build_up boolean, edge_boost double"
)

# Fixed values of the five brushes, in the column order above.
PRESETS = [
    ("soft_round", "soft_round", 0.05, 0.35, 1.0, 1.0, 0.40, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, "normal", 1.0, 0.85, False, 0.0),
    ("marker", "hard_round", 0.03, 0.55, 1.0, 1.0, 0.90, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, "multiply", 1.0, 0.95, False, 0.0),
    ("crayon", "grain", 0.30, 0.45, 1.0, 1.0, 0.35, 1.0, 1.2, 0.0, 0.0, 0.12, 0.0, 1.0, "normal", 0.55, 0.90, False, 0.0),
    ("airbrush", "soft_round", 0.015, 0.50, 1.0, 1.0, 0.30, 1.0, 1.0, 0.35, 0.0, 0.0, 0.0, 0.0, "normal", 0.08, 0.85, True, 0.0),
    ("watercolor", "soft_round", 0.05, 0.40, 1.0, 1.0, 0.35, 1.0, 1.0, 0.45, 0.0, 0.0, 0.0, 0.0, "multiply", 0.15, 0.80, True, 0.60),
]
COLUMNS = [f.strip().split(" ")[0] for f in PRESET_SCHEMA.split(",")]
BRUSHES = tuple(row[0] for row in PRESETS)


def preset_rows() -> dict[str, dict]:
    return {row[0]: dict(zip(COLUMNS, row)) for row in PRESETS}


def preset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, PRESET_SCHEMA)


def with_preset(strokes: DataFrame, brush: str = "brush") -> DataFrame:
    """Preset columns by brush id; the five-row table is fixed, so it is broadcast."""
    table = preset_table(strokes.sparkSession)
    return strokes.join(F.broadcast(table.withColumnRenamed("brush", brush)), brush)


def effective_opacity(override, preset="opacity"):
    """The stroke's own opacity when it has one, otherwise the preset's."""
    return F.coalesce(F.col(override) if isinstance(override, str) else override, F.col(preset))
