"""Sets of 64-bit hashes in plain files of the shared folder: tables pass on where a set stands, never the set."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegrid.llm.common import scratch, store, written
from tidegrid.llm.words import texts

#: Bytes of sets that a reader keeps, about: those read last.
KEPT = 16 << 20
PLACE = ["file", "at", "size"]


def stored(rows: DataFrame, of: Callable[[str | None], np.ndarray]) -> tuple[DataFrame, str]:
    """(node, file, at, size) of the sets of rows (node, text), and the folder of the files: each task writes one.

    A file is named by its attempt, so a repeated task makes another and the rows name the one that is whole.
    """
    folder = scratch(rows.sparkSession, "hashes")

    def packed(batches):
        from pyspark import TaskContext

        name, at, out = TaskContext.get().taskAttemptId(), 0, None
        system, path = store(folder)
        try:
            for batch in batches:
                places = []
                for text in texts(batch.column(1)):
                    raw = of(text).astype("<u8").tobytes()
                    if out is None:
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(raw)
                    places.append((name, at, len(raw)))
                    at += len(raw)
                if places:
                    columns = [pa.array(x, pa.int64()) for x in zip(*places, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", *PLACE])
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(packed, "node long, file long, at long, size long"), "sets"), folder


class Reader:
    """Reads sets by their place, in a worker; those read last stay."""

    def __init__(self, folder: str):
        self.system, self.path = store(folder)
        self.files: OrderedDict[int, pa.NativeFile] = OrderedDict()
        self.kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self.room = KEPT

    def __call__(self, file: int, at: int, size: int) -> np.ndarray:
        if (file, at) in self.kept:
            self.kept.move_to_end((file, at))
            return self.kept[file, at]
        if file not in self.files:
            if len(self.files) >= 64:
                self.files.popitem(last=False)[1].close()
            self.files[file] = self.system.open_input_file(f"{self.path}/{file}")
        raw = self.files[file].read_at(size, at)
        if len(raw) != size:
            raise OSError(f"{self.path}/{file} is not whole: {len(raw)} of {size} bytes at {at}")
        self.kept[file, at] = found = np.frombuffer(raw, "<u8")
        self.room -= size
        while self.room < 0 and len(self.kept) > 1:
            self.room += self.kept.popitem(last=False)[1].nbytes
        return found
