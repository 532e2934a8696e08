import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tandemrank.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture
def pairs(spark):
    """Build a one-key pair frame from two score lists (position is the id)."""

    def build(left, right, grp=None):
        rows = [
            ("p", i, None if l is None else float(l), None if r is None else float(r), str(grp[i]) if grp else str(i))
            for i, (l, r) in enumerate(zip(left, right))
        ]
        return spark.createDataFrame(rows, "panel string, id bigint, left double, right double, grp string")

    return build
