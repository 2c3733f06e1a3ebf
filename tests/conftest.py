import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardstat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app_name="wardstat-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    # a fresh scratch folder per test (never cleared in place)
    return tempfile.mkdtemp(prefix="wardstat-test-")
