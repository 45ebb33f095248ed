import os
import struct
import sys
import tempfile
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tileweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def png(width, height, pixel, channels=3):
    """A PNG from a function (x, y) -> samples."""
    raw = b"".join(b"\0" + bytes(v for x in range(width) for v in pixel(x, y)) for y in range(height))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture()
def px(spark):
    """Pixel table from nested lists: {image_id: rows of (r, g, b, a)}."""

    def build(images):
        rows = [
            (image, x, y, *p, len(lines[0]), len(lines))
            for image, lines in images.items() for y, line in enumerate(lines) for x, p in enumerate(line)
        ]
        return spark.createDataFrame(
            rows, "image_id bigint, x int, y int, r int, g int, b int, a int, width int, height int"
        )

    return build


def grid(df):
    """{image_id: rows of (r, g, b, a)} back from a pixel table."""
    out = {}
    for row in df.collect():
        out.setdefault(row.image_id, {})[(row.y, row.x)] = (row.r, row.g, row.b, row.a)
    shaped = {}
    for image, cells in out.items():
        h, w = max(y for y, _ in cells) + 1, max(x for _, x in cells) + 1
        assert len(cells) == w * h
        shaped[image] = [[cells[(y, x)] for x in range(w)] for y in range(h)]
    return shaped
