"""DADA files: a text header of HDR_SIZE bytes, then blocks of SHAPE numbers of type DTYPE."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_header(path: str) -> dict[str, str]:
    """"KEY value # comment" lines up to the end of the header; of a repeated key the last counts."""
    head: dict[str, str] = {}
    size = 4096
    with open(path, "rb") as f:
        while True:
            f.seek(0)
            for line in f.read(size).split(b"\0")[0].decode("ascii", "replace").splitlines():
                key, _, value = line.partition("#")[0].strip().partition(" ")
                if value.strip():
                    head[key] = value.strip()
            if (whole := int(head.get("HDR_SIZE", size))) <= size:
                return head
            size = whole


class _Block(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first))
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.step, self.shape = options["path"].split(","), int(options.get("step", 1)), options.get("shape")
        self.together = int(options.get("blocks", 16))

    def layout(self, path: str) -> tuple[int, np.dtype, int, int]:
        """Bytes of the header, type, numbers in a block, whole blocks."""
        head = read_header(path)
        shape = self.shape or head.get("SHAPE")
        if not shape or "HDR_SIZE" not in head:
            raise ValueError(f"{path}: no HDR_SIZE or SHAPE")
        kind, count, start = np.dtype(head.get("DTYPE", "<f4")), int(np.prod([int(n) for n in shape.split(",")])), int(head["HDR_SIZE"])
        return start, kind, count, (os.path.getsize(path) - start) // (count * kind.itemsize)

    def partitions(self) -> list[_Block]:
        return [_Block(p, k, min(k + self.together, n)) for p in self.paths for n in [self.layout(p)[3]] for k in range(0, n, self.together)] or [_Block("", 0, 0)]

    def read(self, part: _Block):
        if not part.path:
            return
        start, kind, count, _ = self.layout(part.path)
        with open(part.path, "rb") as f:
            for block in range(-(-part.first // self.step) * self.step, part.last, self.step):
                f.seek(start + block * count * kind.itemsize)
                x = np.frombuffer(f.read(count * kind.itemsize), kind).astype(np.float64)
                values = pa.array(x, mask=~np.isfinite(x))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * count), pa.array(np.full(count, block)), pa.array(np.arange(count)), values], names=["file", "block", "i", "v"])


class Dada(DataSource):
    """spark.read.format("dada").load(paths, comma-separated): file, block, i (place in the block, row-major), v (null where NaN or infinite).

    A short last block is left out. Options: shape (instead of the header's), step (every step-th block), blocks (in a
    partition). Paths must be on storage that all executors mount.
    """

    @classmethod
    def name(cls) -> str:
        return "dada"

    def schema(self) -> str:
        return "file string, block long, i long, v double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_dada(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Dada)
    return spark.read.format("dada").options(**options).load(path)
