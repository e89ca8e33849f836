from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import local_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def collect(df, order):
    """Rows as dicts, sorted by the given columns."""
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(r[c] for c in order))
