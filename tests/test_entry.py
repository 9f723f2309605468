import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from lodestone.plans import registry


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.queries()) <= set(entry.queries())


def test_package_is_shipped(spark):
    entry.shipped(lambda s, d: None)(spark, "")
    files = [f for f in spark.sparkContext._python_includes if f == "lodestone.zip"]
    entry.shipped(lambda s, d: None)(spark, "")
    assert files == ["lodestone.zip"] == [f for f in spark.sparkContext._python_includes if f == "lodestone.zip"]
    assert spark.sparkContext.parallelize([1], 1).map(lambda _: __import__("lodestone").__name__).collect() == ["lodestone"]


def test_entry_works_without_the_optional_parts(tmp_path):
    """In a copy where the folder of the optional operators holds no module, as after their removal with caches left behind."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=lambda d, names: [n for n in names if n == "llm"])
    (tmp_path / "lodestone" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
