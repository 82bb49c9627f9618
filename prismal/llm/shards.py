"""Flat files in the shared folder: written under a name of the attempt's own, read by memory map where local."""

from __future__ import annotations

import uuid
from typing import Any

import numpy as np
from pyarrow import fs


def target(uri: str) -> tuple[Any, str]:
    return fs.FileSystem.from_uri(uri)


class Shard:
    """Files <stem>.<suffix> of one task attempt. A repeated task writes other files; the manifest names those that count."""

    def __init__(self, folder: str, number: int) -> None:
        self.stem = f"{folder}/{number:08d}-{uuid.uuid4().hex[:12]}"
        self.open: dict[str, Any] = {}

    def write(self, suffix: str, data: bytes | memoryview) -> None:
        if suffix not in self.open:
            system, path = target(f"{self.stem}.{suffix}")
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.open[suffix] = system.open_output_stream(path)
        self.open[suffix].write(data)

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped in a local or mounted folder, else read."""
    system, path = target(uri)
    size = system.get_file_info(path).size or 0
    if size == 0:
        return np.empty(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)
