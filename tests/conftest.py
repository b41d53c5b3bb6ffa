import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stockloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = str(tmp_path_factory.mktemp("scratch"))
    session = local_session(4, "6g", shuffle_partitions=4, conf={"spark.checkpoint.dir": scratch})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("test tables are not available")
    return SMALL


@pytest.fixture(scope="session")
def tables(spark, small):
    from stockloom.plans.tables import Tables

    return Tables(spark, small)
