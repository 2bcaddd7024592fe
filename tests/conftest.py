import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import local_session

    s = local_session(8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    # small frames: planning and code generation cost more than the rows (check.py runs with the defaults)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
