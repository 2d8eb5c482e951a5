import os
import shutil
import subprocess
import sys

from tests.conftest import DATA, REPO


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_package(tmp_path):
    shutil.copytree(REPO / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_without_a_package_that_only_training_data_needs(tmp_path):
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(REPO)}, check=True, timeout=120)


def test_data_is_there():
    assert os.path.exists(f"{DATA}/sf0.001/lineitem.parquet")
