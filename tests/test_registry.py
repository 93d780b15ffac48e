"""A sample of registered queries next to their SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

from oracle import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "image_summary", "closed_mosaic", "run_length_encode", "content_hash", "effective_log", "hot_document_fills",
    "session_strokes", "stroke_coverage", "launch_funnel", "backup_quota", "top_clusters", "stream_palette",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry

    ok, text, _ = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name], duck(SF))
    assert ok, text


def test_every_query_without_sql_is_named_in_the_readme():
    import __spark_entry__ as entry

    readme = open(os.path.join(os.path.dirname(entry.__file__), "README.md")).read()
    for name in set(entry.queries()) - set(entry.oracle_sql()):
        assert f"`{name}`" in readme


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_the_rest_works_without_the_document_operators(tmp_path, pipeline_too):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *(["corpus_pipeline.py"] if pipeline_too else []))
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e, bench; print(len(e.queries()), len(e.oracle_sql()), sorted(e.LLM_QUERIES))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
    n, n_sql, documents = said.stdout.split(maxsplit=2)
    assert int(n) > 100 and int(n_sql) > 100 and documents.strip() == "[]"
