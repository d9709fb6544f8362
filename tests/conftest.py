import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlight.session import local_session
    import tempfile
    s = local_session("*", shuffle_partitions=8, app="ledgerlight-tests",
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="ll-warehouse-")})
    yield s
