import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from keepwise.session import build_session

    from keepwise.session import checkpoint_dir

    s = build_session("local[4]", app="keepwise-tests", shuffle_partitions=8)
    checkpoint_dir(s)   # the session's spark.checkpoint.dir, or a scratch folder when unset
    yield s
    s.stop()
