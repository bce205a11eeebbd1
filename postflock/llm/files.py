"""Files in the shared folder, written by tasks.

A file appears under its final name only when it is whole: it is written under
a name of the attempt's own and renamed. Its content follows from its input
alone, so that a repeated or speculative attempt puts the same bytes in place.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow.fs as pafs


def place(uri: str):
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """A file that is written as a stream and appears under its name by ``commit``."""

    def __init__(self, uri: str):
        self.store, self.path = place(uri)
        self.own, self.size, self.sha256 = f"{self.path}.{uuid.uuid4().hex}.tmp", 0, hashlib.sha256()
        self.out = self.store.open_output_stream(self.own, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha256.update(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.store.move(self.own, self.path)


def write(uri: str, parts) -> int:
    """Writes the byte strings of ``parts`` and returns their total length."""
    out = Writer(uri)
    for part in parts:
        out.write(part)
    out.commit()
    return out.size


def read(uri: str) -> bytes:
    store, path = place(uri)
    with store.open_input_file(path) as source:
        return source.read()


def make_folder(uri: str) -> None:
    store, path = place(uri)
    store.create_dir(path, recursive=True)
