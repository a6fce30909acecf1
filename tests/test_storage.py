"""The shared folder with and without the session's setting."""

import os
import subprocess
import sys

import pytest

from spindrift import storage

CODE = """
from pyspark.sql import SparkSession
from spindrift import storage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
a = storage.shared_dir(spark)
assert a == storage.shared_dir(spark) and storage.checkpoint(spark.range(3)).count() == 3
print("FOLDER", a)
"""


def test_a_session_without_the_setting(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert f"FOLDER {tmp_path}" in done.stdout, done.stderr[-2000:]


def test_a_cluster_without_the_setting_is_refused():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, other):
                return other

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)


def test_the_setting_is_used(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert storage.new_path(spark, "x").startswith(storage.shared_dir(spark))
