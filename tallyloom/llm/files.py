"""Files that tasks write and read themselves, in the shared folder of the cluster.

A task writes under a name of its own, so a repeated or speculative attempt
never touches another attempt's file. The list of files that count is a small
table that Spark commits; a file that isn't listed is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, suffix: str) -> Iterator[tuple[str, BinaryIO]]:
    """A new file of this attempt: its address and a stream to write to."""
    where, path = located(folder)
    where.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with where.open_output_stream(f"{path}/{name}") as out:
        yield f"{folder}/{name}", out


@contextmanager
def stream(uri: str) -> Iterator[BinaryIO]:
    where, path = located(uri)
    with where.open_input_stream(path, buffer_size=1 << 20) as f:
        yield f


@contextmanager
def seekable(uri: str) -> Iterator[BinaryIO]:
    where, path = located(uri)
    with where.open_input_file(path) as f:
        yield f


def exactly(f: BinaryIO, n: int) -> bytes:
    """The next ``n`` bytes; an early end is an error."""
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"file ends early: wanted {n} bytes, got {len(got)}")
    return got
