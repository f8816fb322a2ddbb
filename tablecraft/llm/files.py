"""Flat binary files in a folder that all executors reach, by any scheme pyarrow knows."""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


@contextmanager
def written(path: str):
    """A stream whose file appears under ``path`` only when it is whole; a rerun task replaces it by the same bytes."""
    system, name = opened(path)
    system.create_dir(posixpath.dirname(name), recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, name)


def read_range(path: str, start: int, length: int) -> bytes:
    system, name = opened(path)
    with system.open_input_file(name) as file:
        return file.read_at(length, start)


def size_of(path: str) -> int:
    system, name = opened(path)
    return system.get_file_info(name).size
