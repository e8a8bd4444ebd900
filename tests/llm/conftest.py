import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("needs the generated tables")
    return SMALL
