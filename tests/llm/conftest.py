import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parents[2], Path(__file__).resolve().parents[1]):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from shutterlake.session import local_session

    session = local_session("tests", "8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
