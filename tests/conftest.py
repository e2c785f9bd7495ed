import os
import time

import pytest

from rainrisk.session import local_session

os.environ["TZ"] = "UTC"
time.tzset()
# columns are built at import time in some modules, so the session comes first
SESSION = local_session(8, partitions=4)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
