"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["hash", "action"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "cairn", tmp_path / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'prune_plan' in q and not any(x.startswith('op') and x[2].isdigit() for x in q), q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest

    from cairn.shared import LOCAL, shared_dir

    def session(master, conf=None, context=None):
        get = lambda d: lambda key, default=None: (d or {}).get(key, default)
        held = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get(context)))
        return SimpleNamespace(conf=SimpleNamespace(get=get(conf)), sparkContext=held)

    key = "spark.checkpoint.dir"
    assert shared_dir(session("local[4]")) == LOCAL
    assert shared_dir(session("spark://h:1", {key: "hdfs://a/b/"})) == "hdfs://a/b"
    assert shared_dir(session("yarn", None, {key: "s3a://c"})) == "s3a://c"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:1"):
        with pytest.raises(RuntimeError, match="executors share"):
            shared_dir(session(master))
