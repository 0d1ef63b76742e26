"""LAS point clouds as a Spark data source: partitions are record ranges, so one file is read by many tasks.

    spark.dataSource.register(LasSource)
    spark.read.format("las").option("path", "...").load()
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "record long, x double, y double, z double, classification int, red int, green int, blue int"
#: Offset of the colours in records of point formats 0 to 3, by the LAS 1.2 specification; none in 0 and 1.
COLOURS = {0: None, 1: None, 2: 20, 3: 28}
PARTITION_RECORDS = 1_000_000


class Header:
    """The public header block."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"LASF":
            raise ValueError("this is no LAS file")
        self.offset = struct.unpack_from("<I", raw, 96)[0]
        self.format, self.size, self.count = struct.unpack_from("<BHI", raw, 104)
        if self.format not in COLOURS:
            raise ValueError(f"point format {self.format} is not supported")
        self.scale = np.array(struct.unpack_from("<3d", raw, 131))
        self.shift = np.array(struct.unpack_from("<3d", raw, 155))


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.paths = sorted(glob.glob(os.path.join(path, "*.las")) if os.path.isdir(path) else glob.glob(path))
        self.step = int(options.get("partitionrecords", PARTITION_RECORDS))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                n = Header(f.read(227)).count
            out += [Range(path, i, min(self.step, n - i)) for i in range(0, n, self.step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            head = Header(f.read(227))
            f.seek(head.offset + partition.first * head.size)
            done = 0
            while done < partition.count:
                n = min(65_536, partition.count - done)
                raw = np.frombuffer(f.read(n * head.size), dtype=np.uint8)
                if len(raw) != n * head.size:
                    raise ValueError(f"{partition.path} is cut off")
                rows = raw.reshape(n, head.size)
                xyz = np.ascontiguousarray(rows[:, :12]).view("<i4").reshape(n, 3) * head.scale + head.shift
                at = COLOURS[head.format]
                rgb = np.ascontiguousarray(rows[:, at : at + 6]).view("<u2").reshape(n, 3).astype(np.int32) if at else None
                colours = [pa.array(rgb[:, i]) if at else pa.nulls(n, pa.int32()) for i in range(3)]
                index = pa.array(np.arange(partition.first + done, partition.first + done + n, dtype=np.int64))
                kind = pa.array((rows[:, 15] & 31).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [index, *(pa.array(xyz[:, i]) for i in range(3)), kind, *colours],
                    ["record", "x", "y", "z", "classification", "red", "green", "blue"],
                )
                done += n


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)
