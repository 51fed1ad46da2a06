import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from granary.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", 2)
    s.conf.set("spark.sql.adaptive.enabled", "false")  # planning again after each stage costs most of the time on tables as small as these
    return s


@pytest.fixture(scope="session")
def sf():
    return SMALL
