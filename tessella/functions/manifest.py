"""Manifest vocabulary and contract predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.color import as_col

# Fixed values of the pack contract.
SCHEMA_VERSION = "1.0"
ASPECTS = ("1:1", "3:4")
DIFFICULTIES = ("easy", "medium", "focused")
CATEGORIES = ("anime", "mandala", "animal", "botanical", "scenery", "cartoon")
EASY_MAX, MEDIUM_MAX = 60, 200
MAX_REGION_COUNT = 65_535
MASTER_LONG_EDGE = 4096
ID_PATTERN = r"^[a-z0-9]+(-[a-z0-9]+)*$"
HASH_PATTERN = r"^sha256:[0-9a-f]{64}$"
VERSION_PATTERN = r"^[0-9]+\.[0-9]+$"
HEX_PATTERN = r"^#[0-9A-F]{6}$"
MANIFEST_FIELDS = (
    "schema_version",
    "id",
    "content_hash",
    "canvas_size",
    "aspect",
    "region_count",
    "difficulty",
    "category",
    "has_shade",
    "palette",
)
REGION_FIELDS = ("id", "centroid", "area", "bbox", "suggested_color")


def aspect(width: str | Column, height: str | Column) -> Column:
    """Aspect of a master canvas; NULL for any size that is not allowed."""
    w, h = as_col(width), as_col(height)
    return F.when((w == MASTER_LONG_EDGE) & (h == MASTER_LONG_EDGE), "1:1").when(
        (w == MASTER_LONG_EDGE * 3 // 4) & (h == MASTER_LONG_EDGE), "3:4"
    )


def difficulty(regions: str | Column) -> Column:
    n = as_col(regions)
    return F.when(n <= EASY_MAX, "easy").when(n <= MEDIUM_MAX, "medium").otherwise("focused")


def is_category(category: str | Column) -> Column:
    return F.coalesce(as_col(category).isin(*CATEGORIES), F.lit(False))


def version_ok(version: str | Column) -> Column:
    """``major.minor`` in digits, with our major."""
    v = as_col(version)
    major = SCHEMA_VERSION.split(".")[0]
    return F.coalesce(v.rlike(VERSION_PATTERN) & (F.split_part(v, F.lit("."), F.lit(1)) == major), F.lit(False))


def manifest_violations(doc: str | Column) -> Column:
    """Names of the contract rules a manifest JSON string breaks, as an array.

    Types are read from the JSON text: a number in quotes breaks an integer rule.
    """
    doc = as_col(doc)
    raw = F.from_json(doc, "map<string,string>")
    typed = F.from_json(
        doc,
        "schema_version string, id string, content_hash string, canvas_size array<int>, "
        "aspect string, region_count long, difficulty string, category string, "
        "has_shade boolean, palette array<string>",
    )

    def bad(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    rules = [
        bad("object", raw.isNotNull()),
        bad("required", F.size(F.array_except(F.array(*map(F.lit, MANIFEST_FIELDS)), F.map_keys(raw))) == 0),
        bad("extra", F.size(F.array_except(F.map_keys(raw), F.array(*map(F.lit, MANIFEST_FIELDS)))) == 0),
        bad("schema_version", typed["schema_version"].rlike(VERSION_PATTERN)),
        bad("id", typed["id"].rlike(ID_PATTERN)),
        bad("content_hash", typed["content_hash"].rlike(HASH_PATTERN)),
        bad(
            "canvas_size",
            (F.size(typed["canvas_size"]) == 2)
            & F.forall(typed["canvas_size"], lambda v: F.coalesce(v >= 1, F.lit(False))),
        ),
        bad("aspect", typed["aspect"].isin(*ASPECTS)),
        bad("region_count", typed["region_count"].between(1, MAX_REGION_COUNT)),
        bad("difficulty", typed["difficulty"].isin(*DIFFICULTIES)),
        bad("category", typed["category"].isin(*CATEGORIES)),
        bad("has_shade", typed["has_shade"].isNotNull()),
        bad("palette", F.forall(typed["palette"], lambda v: F.coalesce(v.rlike(HEX_PATTERN), F.lit(False)))),
    ]
    return F.filter(F.array(*rules), lambda v: v.isNotNull())


def region_violations(region: Column) -> Column:
    """Contract rules broken by one region struct, as an array of names."""

    def bad(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    rules = [
        bad("id", region["id"].between(0, MAX_REGION_COUNT - 1)),
        bad("area", region["area"] >= 1),
        bad("centroid", (F.size(region["centroid"]) == 2) & F.forall(region["centroid"], lambda v: v >= 0)),
        bad("bbox", (F.size(region["bbox"]) == 4) & F.forall(region["bbox"], lambda v: v >= 0)),
        bad("suggested_color", region["suggested_color"].rlike(HEX_PATTERN)),
    ]
    return F.filter(F.array(*rules), lambda v: v.isNotNull())
