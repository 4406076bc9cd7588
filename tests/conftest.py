from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from syndica.schemas import PAGES  # noqa: E402
from syndica.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "syndica-tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            # keep several partitions, so that borders between them are exercised
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pages(spark):
    """Make a pages table of ``(url, html)`` documents, one page after the other."""
    def make(*docs, feed="f"):
        rows = [(i, feed, i + 1, url, html) for i, (url, html) in enumerate(docs)]
        return spark.createDataFrame(rows, PAGES)

    return make
