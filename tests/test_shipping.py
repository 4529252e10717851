"""Executors get the package from the driver: queries run from a foreign folder."""

import os
import subprocess
import sys

import pytest

from tests.conftest import ROOT, SF_SMALL

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
sys.path.remove({root!r})
from convoscope.session import local_session
spark = local_session(2)
print("rows", len(entry.queries()["occurrence_logit"](spark, {sf!r}).collect()))
"""


def test_python_workers_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=ROOT, sf=SF_SMALL)
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in run.stdout, run.stderr[-2000:]


def test_cluster_without_shared_folder_is_refused():
    from convoscope import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
