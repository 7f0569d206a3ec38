"""Texts and number columns in compressed batches, which operators send between documents and shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textsignal.llm.common import chunks, joined


def packed(values: np.ndarray) -> bytes:
    """Integers with their bytes dealt into planes, so that small ones shrink."""
    size = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def bundle(docs: DataFrame, limit: int) -> DataFrame:
    """Texts in compressed batches: ``batch, docs``. Batches have ``limit`` bytes, or less at a task's end."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=6)
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_pydict({"batch": [part << 32 | n], "docs": [press.compress(sink.getvalue().to_pybytes())]})

        for b in batches:
            _, at = joined(b.column("text"))
            for low, high in chunks(at, limit):
                held.append(b.slice(low, high - low))
                size += int(at[high] - at[low])
                if size >= limit:
                    yield flush()
                    held, size, n = [], 0, n + 1
        if held:
            yield flush()

    return docs.mapInArrow(run, "batch long, docs binary")


def unbundled(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
