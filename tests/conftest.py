import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from logweave.session import get_session

    s = get_session("local[4]", app="logweave-tests", shuffle_partitions=8)
    # the parse projection is wider than one JVM method; skip the fused-stage
    # compile attempt in tests (results are the same, runs are faster)
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    yield s
    s.stop()
