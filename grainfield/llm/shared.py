"""What the corpus operators share: the cluster's shared folder, cut lineage, whole-text byte helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Tables, cut, new_path, shared_dir  # noqa: F401

#: A-Z to a-z, every other byte as it is (UTF-8 stays valid).
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def crc_mod(column: str, n: int):
    """crc32 of a column's decimal text, mod n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that clash with nothing an operator adds, and those names by the old ones."""
    names = {c: f"__own{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that `aside` renamed, under their old names, and no others."""
    return found.select(*(F.col(new).alias(old) for old, new in names.items()))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system: idle workers stay, and count, beside other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about `most` bytes of text (a longer text stands alone).
    Memory is given back after each batch and at the end."""
    for batch in batches:
        size = batch.schema.get_field_index(column)
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(size)), 0), dtype=np.int64)
        group = np.concatenate([[0], np.cumsum(lengths)[:-1] // most]) if len(lengths) else lengths
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
            yield batch.slice(a, b - a)
        del batch
        give_back()
