import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from braidwork.session import local_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)
    return s
