"""Heap files of texts in the shared folder: appended by one task attempt each, read by range."""

from __future__ import annotations

import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext

from .common import store_of


class HeapWriter:
    """Appends texts to a file of its own; the name holds the attempt, so that a task run twice never writes into a file in use."""

    def __init__(self, folder: str) -> None:
        task = TaskContext.get()
        self.path = f"{folder}/{task.partitionId() if task else 0}-{task.taskAttemptId() if task else 0}-{uuid.uuid4().hex[:8]}.heap"
        self.out, self.at, self.pack = None, 0, zstandard.ZstdCompressor(level=1).compress

    def put(self, text: bytes, head: bytes = b"") -> tuple[str, int, int]:
        """The file, the offset of the head, which is kept as it is, and the length of the text behind it."""
        if self.out is None:
            store, name = store_of(self.path)
            store.create_dir(name.rpartition("/")[0], recursive=True)
            self.out = store.open_output_stream(name)
        body = self.pack(text)
        self.out.write(head + body)
        self.at += len(head) + len(body)
        return self.path, self.at - len(head) - len(body), len(body)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class Heap:
    """Reads texts from heap files; files stay open, the last texts are kept."""

    def __init__(self) -> None:
        self.files: dict[str, pa.NativeFile] = {}
        self.last: dict[tuple[str, int], bytes] = {}
        self.unpack = zstandard.ZstdDecompressor().decompress

    def read(self, file: str, offset: int, length: int) -> bytes:
        if (found := self.last.get((file, offset))) is not None:
            return found
        text = self.unpack(self.raw(file, offset, length))
        if len(self.last) >= 4:
            self.last.pop(next(iter(self.last)))
        self.last[file, offset] = text
        return text

    def raw(self, file: str, offset: int, length: int) -> bytes:
        """Bytes as they stand."""
        if file not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            store, name = store_of(file)
            self.files[file] = store.open_input_file(name)
        return self.files[file].read_at(length, offset)
