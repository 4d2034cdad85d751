import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shortlist.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # the shared folder is named as on a cluster, so that this way is the one that is tested
    return local_session(8, partitions=4, spark__checkpoint__dir=tempfile.mkdtemp(prefix="shortlist-tests-"))
