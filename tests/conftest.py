import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lakebuild.session import get_spark
    s = get_spark("local[4]", app_name="lakebuild-tests", shuffle_partitions=4)
    yield s


@pytest.fixture()
def tmp_uri(tmp_path):
    return "file:" + str(tmp_path)
