"""Random access to file content: whole values that a row holds, or ranges read from the file where they are needed."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of the first read, and the unit of later ones.
FIRST_READ, BLOCK = 2048, 1024


class Content:
    """``get`` exactly some bytes, or ``some``: what there is of them. ``n_read`` counts bytes fetched."""

    def __init__(self, data: bytes):
        self.data, self.length, self.n_read = data, len(data), len(data)

    def some(self, at: int, n: int) -> bytes:
        return self.data[at : at + n] if at >= 0 and n > 0 else b""

    def get(self, at: int, n: int) -> bytes:
        found = self.some(at, n)
        if len(found) < n:
            raise EOFError(f"{n} bytes at {at} are not all there")
        return found

    def number(self, at: int, n: int, order: str = "big") -> int:
        return int.from_bytes(self.get(at, n), order)

    def windows(self, first: int = FIRST_READ) -> Iterator[tuple[bytes, bool]]:
        """Ever longer beginnings, each twice as long as the last, with a flag for the whole."""
        while True:
            yield self.some(0, first), first >= self.length
            if first >= self.length:
                return
            first *= 2

    def find(self, pattern: bytes, at: int = 0, step: int = 1 << 20) -> int:
        """The first match of a regular expression of at most 64 bytes, or -1. Reads on until there is one."""
        while at < self.length:
            m = re.search(pattern, self.some(at, step + 64), re.S)
            if m:
                return at + m.start()
            at += step
        return -1


class FileRanges(Content):
    """Reads ``BLOCK``-aligned ranges of a file and keeps them while it is open."""

    def __init__(self, path: str):
        file_system, name = open_location(path)
        self.file = file_system.open_input_file(name)
        self.length, self.n_read = self.file.size(), 0
        self.blocks: dict[int, bytes] = {}
        if self.length:
            self._fetch(0, (min(self.length, FIRST_READ) - 1) // BLOCK)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _fetch(self, first: int, last: int) -> None:
        raw = self.file.read_at((last - first + 1) * BLOCK, first * BLOCK)
        self.n_read += len(raw)
        for k in range(first, last + 1):
            self.blocks[k] = raw[(k - first) * BLOCK : (k - first + 1) * BLOCK]

    def some(self, at: int, n: int) -> bytes:
        n = min(n, self.length - at)
        if at < 0 or n <= 0:
            return b""
        first, last = at // BLOCK, (at + n - 1) // BLOCK
        if last - first > 256:
            # A long range passes by; keeping its blocks would keep the file.
            self.n_read += n
            return self.file.read_at(n, at)
        missing = [k for k in range(first, last + 1) if k not in self.blocks]
        while missing:
            run = 1
            while run < len(missing) and missing[run] == missing[0] + run:
                run += 1
            self._fetch(missing[0], missing[run - 1])
            missing = missing[run:]
        raw = b"".join(self.blocks[k] for k in range(first, last + 1))
        return raw[at - first * BLOCK : at - first * BLOCK + n]


class Slices(Content):
    """Extents of another content, one after the other, as one."""

    def __init__(self, base: Content, extents: list[tuple[int, int]]):
        self.base, self.extents, self.length = base, extents, sum(n for _, n in extents)

    @property
    def n_read(self) -> int:
        return self.base.n_read

    def some(self, at: int, n: int) -> bytes:
        out, begin = [], 0
        for start, size in self.extents:
            a, b = max(at, begin), min(at + n, begin + size)
            if a < b:
                out.append(self.base.some(start + a - begin, b - a))
            begin += size
        return b"".join(out)


def open_location(path: str):
    """File system and name of a path as Spark writes it: with a scheme (``file:/...`` included) or without."""
    from pyarrow import fs

    local = re.match(r"file:(?://(?=/))?(/.*)", path, re.S)
    if local or "://" not in path:
        return fs.LocalFileSystem(), local[1] if local else path
    return fs.FileSystem.from_uri(path)


def as_content(data) -> Content:
    return data if isinstance(data, Content) else Content(bytes(data))


def boxes(d: Content, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin of the body and end of the boxes between two positions; ``EOFError`` if one goes on behind them."""
    while at + 8 <= end:
        size, kind, body = d.number(at, 4), d.get(at + 4, 4), at + 8
        if size == 1:
            size, body = d.number(at + 8, 8), at + 16
        size = size or end - at
        if size < body - at or at + size > end:
            raise EOFError("box goes on")
        yield kind, body, at + size
        at += size


def meta_box(d: Content) -> tuple[int, int] | None:
    """Where the boxes inside the top ``meta`` box are; it may follow the pixels. None if the file has none."""
    for kind, body, end in boxes(d, 0, d.length):
        if kind == b"meta":
            return body + 4, end
    return None
