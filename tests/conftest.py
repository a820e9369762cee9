import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fieldlink.session import build_session

    s = build_session("local[4]", 8)
    yield s
    s.stop()


def rel(asset_id: str, filename: str) -> str:
    """An asset file's path below a volume root in the default (sharded) layout."""
    return f"{asset_id[:2]}/{asset_id}/{filename}"
