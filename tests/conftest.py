import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfdate.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", master="local[8]", shuffle_partitions=4, extra={
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("cut")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh"))})
    yield session
    session.stop()


BOXES = ("image_id string, stage string, box_index int, text string, confidence double, "
         "bbox array<array<double>>")


def rect(x, y, w, h):
    return [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]]


def stacked(image_id, lines, stage="original_512", confidence=0.9):
    """One 300 x 30 box per line, 40 pixels apart."""
    return [(image_id, stage, i, t, confidence, rect(0, 40 * i, 300, 30)) for i, t in enumerate(lines)]
