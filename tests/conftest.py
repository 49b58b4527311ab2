import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tallyhouse.session import session

    found = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
