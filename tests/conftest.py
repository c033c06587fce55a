import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tillwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def pairs(spark, folder):
    from tillwise.plans.queries import _written_pairs

    return _written_pairs(spark, folder)
