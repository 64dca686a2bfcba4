"""The shared folder where spark.checkpoint.dir is unset."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from ledgerlens.sources import scratch

RUN = """
from pathlib import Path
from ledgerlens.session import local_session
from ledgerlens.sources.scratch import new_folder
spark = local_session("scratch", cpus=1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
path = new_folder(spark, "t")
spark.range(3).write.parquet(path)
assert spark.read.parquet(path).count() == 3 and new_folder(spark, "t") != path
print("FOLDER", Path(path.removeprefix("file://")).parent.parent)
"""


def test_unset_on_a_local_master(tmp_path):
    home = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": home}
    out = subprocess.run([sys.executable, "-c", RUN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    folder = out.stdout.split("FOLDER ")[1].strip()
    assert "ledgerlens-" in folder and not Path(folder).exists()


def test_unset_on_a_cluster():
    class Context:
        master, applicationId = "spark://there:7077", "app-1"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Session())
