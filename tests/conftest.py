import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from lodestack.session import local_session

    session = local_session(4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    return session
