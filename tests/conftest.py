from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tabscope.session import local_session  # noqa: E402
from tabscope.settings import Settings  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, partitions=4)


@pytest.fixture(scope="session")
def scaled():
    """Limits so low that small fixtures take the paths meant for large tables."""
    return Settings(small_group_rows=7)


def rows(df, *keys):
    """Rows as dicts, by the given keys if any."""
    data = [r.asDict() for r in df.collect()]
    return {tuple(d[k] for k in keys) if len(keys) > 1 else d[keys[0]]: d for d in data} if keys else data
