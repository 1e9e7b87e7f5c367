"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_llm_folder(tmp_path):
    copy = str(tmp_path / "repo")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": copy})


def test_entry_query(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["vid", "prob"] and got.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_folder_and_shuffle_setting(spark):
    from factorloom.session import shared_dir, shuffles_dropped

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(flag)
    with shuffles_dropped(spark):
        assert spark.conf.get(flag) == "true" and spark.range(10).groupBy("id").count().count() == 10
    assert spark.conf.get(flag) == before
