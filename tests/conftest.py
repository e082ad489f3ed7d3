import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "scripts"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shopfloor.session import build_session

    ckpt = tempfile.mkdtemp(prefix="shopfloor-test-ckpt-")
    s = build_session("local[*]", 8, extra={"spark.checkpoint.dir": ckpt,
                                             "spark.shopfloor.pii.secret": "0123456789abcdef0123456789abcdef"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from oracle_compare import duck_connect
    return duck_connect(SMALL)
