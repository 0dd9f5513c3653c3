"""Shared fixtures: one local session for the whole run (tests may set their own
checkpoint folder because the local session names none)."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.session import build_session, checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=8, app="riskloom-tests", driver_memory="4g")
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="riskloom-ckpt-"))
    yield s
    s.stop()


def rows(df, *cols):
    """Collect ``cols`` (all columns when empty) as a list of tuples in the frame's order."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
