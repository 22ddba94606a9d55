"""Data source of raw plane files: a small header, then planes of one type, read one plane a partition."""

from __future__ import annotations

import glob
import os
import struct

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.types import StructType

MAGIC = b"GFP1"
TYPES = {1: "<u1", 2: "<u2", 4: "<f4"}


def write_planes(path: str, stack: np.ndarray) -> None:
    """A (t, c, z, y, x) array as one file."""
    kind = {np.dtype(v): k for k, v in TYPES.items()}[stack.dtype.newbyteorder("<")]
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<6I", kind, *stack.shape))
        f.write(np.ascontiguousarray(stack).astype(TYPES[kind]).tobytes())


def read_header(path: str) -> tuple[str, tuple[int, ...]]:
    with open(path, "rb") as f:
        head = f.read(28)
    if head[:4] != MAGIC:
        raise ValueError(f"{path} is no plane file")
    kind, *shape = struct.unpack("<6I", head[4:])
    return TYPES[kind], tuple(shape)


class _Plane(InputPartition):
    def __init__(self, path: str, t: int, c: int, z: int):
        self.path, self.t, self.c, self.z = path, t, c, z


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.fixed = path, {}

    def pushFilters(self, filters):
        """Equality on t, c and z prunes planes before any is opened."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("t", "c", "z"):
                self.fixed[f.attribute[0]] = f.value
            yield f  # Spark filters again, so pruning may be partial

    def partitions(self):
        out = []
        for path in sorted(glob.glob(os.path.join(self.path, "*.gfp")) if os.path.isdir(self.path) else [self.path]):
            _, (nt, nc, nz, _, _) = read_header(path)
            out += [_Plane(path, t, c, z) for t in range(nt) for c in range(nc) for z in range(nz) if all({"t": t, "c": c, "z": z}[k] == v for k, v in self.fixed.items())]
        return out

    def read(self, part: _Plane):
        kind, (_, nc, nz, h, w) = read_header(part.path)
        size = np.dtype(kind).itemsize * h * w
        with open(part.path, "rb") as f:
            f.seek(28 + ((part.t * nc + part.c) * nz + part.z) * size)
            data = np.frombuffer(f.read(size), kind)
        yield (os.path.basename(part.path), part.t, part.c, part.z, h, w, data.astype(float).tolist())


class PlaneSource(DataSource):
    """spark.read.format("planes").load(path): one row for each plane of the file, or of a folder's .gfp files."""

    @classmethod
    def name(cls) -> str:
        return "planes"

    def schema(self) -> str:
        return "img string, t int, c int, z int, h int, w int, data array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlaneSource)


def pixels(planes):
    """Planes as pixel rows."""
    from pyspark.sql import functions as F

    flat = planes.select("img", "t", "c", "z", "w", F.posexplode("data").alias("at", "v"))
    return flat.select("img", "t", "c", "z", F.floor(F.col("at") / F.col("w")).cast("int").alias("y"), (F.col("at") % F.col("w")).cast("int").alias("x"), "v")
