import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from memoria.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="memoria-test-ckpt-", dir="/tmp")
    warehouse = tempfile.mkdtemp(prefix="memoria-test-wh-", dir="/tmp")
    s = get_spark(4, shuffle_partitions=4, app="memoria-tests",
                  extra={"spark.checkpoint.dir": ckpt, "spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="memoria-test-out-", dir="/tmp")
