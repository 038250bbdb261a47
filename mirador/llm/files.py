"""Files that tasks write to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@contextmanager
def writer(folder: str, name: str):
    """A stream to ``folder/name`` through a name of this attempt's own and a rename, so a
    task that runs twice leaves one whole file."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/_{uuid.uuid4().hex}"
    with store.open_output_stream(draft, compression=None) as out:
        yield out
    store.move(draft, f"{path}/{name}")


def put(folder: str, name: str, data: bytes) -> str:
    with writer(folder, name) as out:
        out.write(data)
    return f"{folder}/{name}"


def chunks(path: str, size: int = 1 << 18) -> Iterator[bytes]:
    """A file's bytes, ``size`` at a time."""
    store, name = _store(path)
    with store.open_input_stream(name, compression=None) as file:
        while part := file.read(size):
            yield part
