import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from maskloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def raster(spark):
    """A pixel frame from {image_id: {column: 2-D list}}."""
    def build(images: dict, kinds: dict | None = None):
        rows, names = [], None
        for image_id, layers in images.items():
            names = list(layers)
            grid = layers[names[0]]
            for r in range(len(grid)):
                for c in range(len(grid[0])):
                    rows.append((image_id, r, c, *[layers[n][r][c] for n in names]))
        kinds = kinds or {}
        fields = ", ".join(f"{n} {kinds.get(n, 'int')}" for n in names)
        return spark.createDataFrame(rows, f"image_id bigint, row int, col int, {fields}")

    return build


@pytest.fixture(scope="session")
def grid_of():
    """A 2-D list of one image's column."""
    def collect(df, column, image_id=1):
        cells = {(r["row"], r["col"]): r[column] for r in df.where(f"image_id = {image_id}").collect()}
        height, width = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
        return [[cells[r, c] for c in range(width)] for r in range(height)]

    return collect
