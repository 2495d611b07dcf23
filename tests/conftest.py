import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from phrasemill.session import get_session
    s = get_session("local[4]", "phrasemill-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="pm-test-ckpt-")})
    yield s
    s.stop()


SF = os.environ.get("PM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
