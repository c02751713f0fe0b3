import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from talkmill.session import build_session

    session = build_session("talkmill-tests", "8", 2)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    # The inputs are tiny: compiling a stage takes longer than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()
