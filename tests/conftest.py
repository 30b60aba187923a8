import os
import shutil
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from marlstone.plans import session

    folder = tempfile.mkdtemp(prefix="tests-")  # nothing that an earlier run kept is read
    s = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": folder})
    yield s
    s.stop()
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data here")
    return SF_DIR
