import pytest
from pyspark.sql import functions as F

from tessella.functions import shape as S
from tessella.operators import labels as L
from tessella.operators import runs as U
from tessella.plans.params import BakeParams


def test_frozen_hash(spark):
    rows = [(1, 0, "regions.bin", 0, b"\x01\x02"), (1, 0, "regions.bin", 1, b"\x03"), (1, 1, "lineart.png", 0, b"\x89PNG")]
    df = spark.createDataFrame(rows, "image_id long, entry int, name string, chunk_no long, data binary")
    got = U.content_hash(df).first()["content_hash"]
    assert got == "sha256:c68347503153ae31bec089081b121339b30de4d0456c8c87403bd20593919826"


def test_runs_are_split_at_the_length_limit(spark):
    px = spark.range(70_000).selectExpr("0L as image_id", "cast(id % 250 as int) as x", "cast(id div 250 as int) as y", "7L as label")
    got = [(r["run_no"], r["len"], r["id"]) for r in U.encode_runs(px).orderBy("run_no").collect()]
    assert got == [(0, 65_535, 7), (1, 4_465, 7)]


def test_parameters():
    assert BakeParams().override("max_line_ratio", "0.5").max_line_ratio == 0.5
    for key, value in [("line_treshold", "1"), ("line_threshold", "256"), ("min_seed_area", "-1"), ("max_line_ratio", "1.5"), ("max_line_ratio", "nan")]:
        with pytest.raises(ValueError):
            BakeParams().override(key, value)


def test_contrast_colors_match_greedy_colouring(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 3), (1, 3), (3, 4)]
    regions = spark.range(5).selectExpr("9L as image_id", "id as label")
    adjacent = spark.createDataFrame([(9, a, b) for a, b in edges], "image_id long, a long, b long")
    got = {r["label"]: r["color"] for r in L.contrast_colors(regions, adjacent).collect()}
    colors, want = L.preview_candidates(), {}
    for i in range(5):
        near = [colors[want[a]] for a, b in edges if b == i]

        def score(k):
            return min((sum((p - q) ** 2 for p, q in zip(colors[k], c)) for c in near), default=1 << 40)

        want[i] = max(range(len(colors)), key=lambda k: (score(k), -k))
    assert got == want and len(set(colors)) == 24


def test_not_a_number_is_off_canvas(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (3.0, 1.0), (-0.5, 1.0), (4.0, 1.0)], "x double, y double")
    inside = df.select(S.on_canvas(F.floor("x").cast("double"), F.floor("y"), F.lit(4), F.lit(4)) & ~F.isnan("x")).collect()
    assert [r[0] for r in inside] == [False, True, False, False]
