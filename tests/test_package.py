"""The package works from any folder, and needs a shared folder."""

import os
import subprocess
import sys

import pytest
from motorgrid import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.remove({REPO!r})
print("ROWS", len(e.entry(spark).collect()))
"""


def test_entry_runs_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=300)
    assert "ROWS 31" in done.stdout, done.stderr[-2000:]


LISTING = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from pyspark import SparkContext
names = set(e.queries())
assert set(e.oracle_sql()) <= names
assert SparkContext._active_spark_context is None
print("NAMES", len(names))
"""


def test_queries_are_listed_without_a_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", LISTING], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=120)
    assert "NAMES" in done.stdout, done.stderr[-2000:]


class _Unset:
    """A session without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        @staticmethod
        def getCheckpointDir():
            return None


def test_shared_folder_must_be_set():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Unset())


def test_shared_paths_are_new_uris(spark):
    a, b = session.shared_path(spark, "x"), session.shared_path(spark, "x")
    assert a != b and a.startswith("file:///")
