"""Parameters of a bake, checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tessella.functions.color import LINE_THRESHOLD
from tessella.operators.quality import MAX_LINE_RATIO
from tessella.operators.regions import MIN_ORPHAN_AREA, MIN_SEED_AREA


@dataclass(frozen=True)
class BakeParams:
    line_threshold: int = LINE_THRESHOLD
    min_seed_area: int = MIN_SEED_AREA
    min_orphan_area: int = MIN_ORPHAN_AREA
    max_line_ratio: float = MAX_LINE_RATIO

    def override(self, key: str, value: str) -> "BakeParams":
        """A copy with one parameter set from text; a wrong key, type or range is an error."""
        limits = {"line_threshold": 255, "min_seed_area": 2**32 - 1, "min_orphan_area": 2**32 - 1}
        if key in limits:
            if not (value.isascii() and value.isdigit()) or int(value) > limits[key]:
                raise ValueError(f"{key}={value}: expected an integer from 0 to {limits[key]}")
            return replace(self, **{key: int(value)})
        if key == "max_line_ratio":
            try:
                ratio = float(value)
            except ValueError:
                raise ValueError(f"{key}={value}: expected a number") from None
            if not 0.0 <= ratio <= 1.0:
                raise ValueError(f"{key}={value}: expected a ratio from 0 to 1")
            return replace(self, max_line_ratio=ratio)
        raise ValueError(
            f"unknown parameter {key!r}; known: line_threshold, min_seed_area, min_orphan_area, max_line_ratio"
        )
