"""TIFF pages as planes: any path that Spark can read, classic and big files, both byte orders, uncompressed strips or tiles.

A file is one row of Spark's binary reader, so it is parsed where it is read; pages that are not asked for are not decoded,
and what leaves a task are planes as arrays, one row each. Files must stay under the reader's limit of 2 GB."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: sizes and codes of field types, and the tags that are read.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "2I", 6: "b", 8: "h", 9: "i", 10: "2i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 270: "description", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 282: "x_resolution", 283: "y_resolution", 296: "unit", 305: "software", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 339: "format"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
PLANES = "path string, page int, height int, width int, data array<double>"
PAGES = "path string, page int, height int, width int, bits int, description string, software string, pixel_um double"


class Broken(ValueError):
    """A file that is no TIFF, ends early, or is written in a way that is not supported."""


def pages(raw: bytes) -> list[dict]:
    """Tags of every page, in order."""
    if raw[:2] not in (b"II", b"MM") or len(raw) < 8:
        raise Broken("no TIFF")
    order = "<" if raw[:2] == b"II" else ">"

    def read(code: str, at: int) -> tuple:
        if at < 0 or at + struct.calcsize(order + code) > len(raw):
            raise Broken("the file ends early")
        return struct.unpack_from(order + code, raw, at)

    (version,) = read("H", 2)
    if version not in (42, 43):
        raise Broken("no TIFF")
    word, count, width, at = ("I", "H", 4, read("I", 4)[0]) if version == 42 else ("Q", "Q", 8, read("Q", 8)[0])
    out, seen = [], set()
    while at:
        if at in seen:
            raise Broken("pages form a ring")
        seen.add(at)
        (n,) = read(count, at)
        at += struct.calcsize(order + count)
        page = {}
        for k in range(n):
            place = at + k * (4 + 2 * width)
            tag, kind = read("HH", place)
            if tag not in TAGS or kind not in TYPES:
                continue
            (many,) = read(word, place + 4)
            code = f"{many}s" if kind == 2 else TYPES[kind] * many if len(TYPES[kind]) > 1 else f"{many}{TYPES[kind]}"
            here = place + 4 + width
            page[TAGS[tag]] = read(code, here if struct.calcsize(order + code) <= width else read(word, here)[0])
        out.append(page)
        (at,) = read(word, at + n * (4 + 2 * width))
    return [p | {"order": order} for p in out]


def plane(raw: bytes, page: dict) -> np.ndarray:
    """A page's first sample as an array."""
    one = lambda name, default: page.get(name, (default,))[0]
    if one("compression", 1) != 1:
        raise Broken(f"compression {one('compression', 1)} is not supported")
    kind = KINDS.get((one("format", 1), one("bits", 1)))
    if kind is None or "width" not in page or "height" not in page:
        raise Broken("pixels of this kind are not supported")
    kind, samples = np.dtype(page["order"] + kind), one("samples", 1)
    height, width = one("height", 0), one("width", 0)
    tiled = "tile_offsets" in page
    high, wide = (one("tile_height", height), one("tile_width", width)) if tiled else (min(one("rows", height), height), width)
    across, out = -(-width // wide), np.zeros((height, width), kind)
    for k, at in enumerate(page["tile_offsets" if tiled else "offsets"]):
        y, x = k // across * high, k % across * wide
        if y >= height:
            break  # further samples, kept apart
        rows = high if tiled else min(high, height - y)
        if at + rows * wide * samples * kind.itemsize > len(raw):
            raise Broken("the file ends early")
        part = np.frombuffer(raw, kind, rows * wide * samples, at).reshape(rows, wide, samples)[..., 0]
        out[y : y + rows, x : x + wide] = part[: height - y, : width - x]
    return out


def _pixel_um(page: dict) -> float | None:
    """Pixel size by resolution and unit (inch or centimetre); none where no unit is named."""
    size = {2: 25400.0, 3: 10000.0}.get(page.get("unit", (2,))[0] if "x_resolution" in page and "unit" in page else None)
    over, under = page.get("x_resolution", (0, 1))
    return size * under / over if size and over and under else None


def _text(page: dict, name: str) -> str | None:
    return page[name][0].split(b"\0")[0].decode("utf-8", "replace") if name in page else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path).select("path", "content")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What each page says of itself, without its pixels; broken files give one row with a null page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAGES.split(", ")]
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(name, k, p["height"][0], p["width"][0], p.get("bits", (1,))[0], _text(p, "description"), _text(p, "software"), _pixel_um(p)) for k, p in enumerate(pages(raw))]
                except (Broken, KeyError):
                    rows.append((name, *[None] * (len(names) - 1)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return _files(spark, path).mapInArrow(run, PAGES)


def read_planes(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Pages first to last of each file, one row each, with all pixels as doubles in reading order. A broken file is an
    error that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    for k, p in enumerate(pages(raw)):
                        if k < first or last is not None and k > last:
                            continue
                        a = plane(raw, p)
                        data = pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), pa.array(a.astype(np.float64).ravel()))
                        yield pa.record_batch([pa.array([name]), pa.array([k], pa.int32()), pa.array([a.shape[0]], pa.int32()), pa.array([a.shape[1]], pa.int32()), data], names=["path", "page", "height", "width", "data"])
                except Broken as e:
                    raise Broken(f"{name}: {e}") from None

    return _files(spark, path).mapInArrow(run, PLANES)


def as_pixels(planes: DataFrame) -> DataFrame:
    """Planes as pixel rows (img, t, y, x, v), where an operator joins pixels."""
    at = planes.select(F.col("path").alias("img"), F.col("page").alias("t"), "width", F.posexplode("data").alias("p", "v"))
    return at.select("img", "t", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).alias("x"), "v")


def written(images: list[np.ndarray], big: bool = False, order: str = "<", description: str = "", per_cm: int | None = None, tile: int | None = None) -> bytes:
    """A TIFF of these pages, uncompressed, in one strip or in square tiles each."""
    word, count, width = ("Q", "Q", 8) if big else ("I", "H", 4)
    out = bytearray(b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42)
    out += struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + "I", 0)
    link = len(out) - width
    for a in images:
        a = a.astype(a.dtype.newbyteorder(order))
        blocks = [a] if tile is None else []
        for y in range(0, a.shape[0], tile) if tile else ():
            for x in range(0, a.shape[1], tile):
                block = np.zeros((tile, tile), a.dtype)
                block[: a.shape[0] - y, : a.shape[1] - x] = a[y : y + tile, x : x + tile]
                blocks.append(block)
        places = []
        for block in blocks:
            places.append(len(out))
            out += block.tobytes()
        where, size = ((273, 279) if tile is None else (324, 325)), [b.nbytes for b in blocks]
        fields = [(256, 4, [a.shape[1]]), (257, 4, [a.shape[0]]), (258, 3, [a.dtype.itemsize * 8]), (259, 3, [1]), (270, 2, description.encode() + b"\0"), (where[0], 16 if big else 4, places), (277, 3, [1]), (where[1], 4, size)]
        fields += [(339, 3, [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]])] + ([(278, 4, [a.shape[0]])] if tile is None else [(322, 4, [tile]), (323, 4, [tile])])
        fields += [(282, 5, [(per_cm, 1)]), (296, 3, [3])] if per_cm else []
        body = []
        for tag, kind, values in sorted(fields):
            raw = bytes(values) if kind == 2 else b"".join(struct.pack(order + TYPES[kind], *(v if isinstance(v, tuple) else (v,))) for v in values)
            if len(raw) > width:
                at = len(out)
                out += raw
                raw = struct.pack(order + word, at)
            body.append(struct.pack(order + "HH" + word, tag, kind, len(values)) + raw.ljust(width, b"\0"))
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + count, len(body)) + b"".join(body)
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)
