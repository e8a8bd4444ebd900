import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from segstat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("*", "segstat-tests", "10g", 4)


@pytest.fixture
def small_limit(monkeypatch):
    """Every group above three rows counts as oversized, so the range-splitting plans run."""
    from segstat.plans import ordering
    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", 3)
