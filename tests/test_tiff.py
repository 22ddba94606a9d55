"""TIFF pages written and read back, in all layouts; broken files."""

import numpy as np
import pytest

from grainfield.functions import arrays
from grainfield.operators import planes
from grainfield.sources import tiff

RNG = np.random.default_rng(2)


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "u4", "f4", "f8"])
@pytest.mark.parametrize("tile", [None, 16])
def test_round_trip(big, order, kind, tile):
    images = [(RNG.random((h, w)) * 200).astype(kind) for h, w in ((5, 7), (33, 20), (1, 1))]
    raw = tiff.written(images, big, order, "a note", 1000, tile)
    found = tiff.pages(raw)
    assert len(found) == 3 and all((tiff.plane(raw, p) == a).all() for p, a in zip(found, images, strict=True))
    assert tiff._text(found[1], "description") == "a note" and tiff._pixel_um(found[0]) == 10.0


def test_broken_files():
    raw = tiff.written([np.arange(600, dtype="u2").reshape(20, 30)])
    for bad in (b"", b"II", b"not an image", raw[:40], raw[:-3]):
        with pytest.raises(tiff.Broken):
            [tiff.plane(bad, p) for p in tiff.pages(bad)]
    packed = bytearray(raw)
    at = raw.index(b"\x03\x01\x03\x00\x01\x00\x00\x00") + 8
    packed[at] = 5
    with pytest.raises(tiff.Broken, match="compression 5"):
        tiff.plane(bytes(packed), tiff.pages(bytes(packed))[0])


def test_planes_of_a_folder(spark, tmp_path):
    a, b = [RNG.integers(0, 999, (4, 6)).astype("u2") for _ in range(3)], [RNG.random((3, 5)).astype("f4")]
    (tmp_path / "a.tif").write_bytes(tiff.written(a, description="three", per_cm=20000))
    (tmp_path / "b.tiff").write_bytes(tiff.written(b, big=True))
    (tmp_path / "note.txt").write_text("no image")
    found = {(r.path.rsplit("/", 1)[1], r.page): np.array(r.data).reshape(r.height, r.width) for r in tiff.read_planes(spark, f"file://{tmp_path}").collect()}
    assert set(found) == {("a.tif", 0), ("a.tif", 1), ("a.tif", 2), ("b.tiff", 0)} and (found["a.tif", 2] == a[2]).all() and (found["b.tiff", 0] == b[0]).all()
    assert [r.page for r in tiff.read_planes(spark, f"file://{tmp_path}/a.tif", 1, 1).collect()] == [1]
    px = tiff.as_pixels(tiff.read_planes(spark, f"file://{tmp_path}/a.tif", 0, 0))
    assert {(r.y, r.x): r.v for r in px.collect()} == {(y, x): float(a[0][y, x]) for y in range(4) for x in range(6)}
    smooth = planes.filtered_arrays(tiff.read_planes(spark, f"file://{tmp_path}/a.tif"), "gaussian", sigma=2.0)
    assert all(np.allclose(np.array(r.data).reshape(4, 6), arrays.gaussian(a[r.page], 2.0)) for r in smooth.collect()) and smooth.count() == 3
    (tmp_path / "c.tif").write_bytes(b"II*\0broken")
    said = {(r.path.rsplit("/", 1)[1], r.page): r for r in tiff.read_pages(spark, f"file://{tmp_path}").collect()}
    assert said["a.tif", 1].description == "three" and said["a.tif", 1].pixel_um == 0.5 and said["b.tiff", 0].bits == 32 and said["c.tif", None].height is None
    with pytest.raises(Exception, match="c.tif"):
        tiff.read_planes(spark, f"file://{tmp_path}").collect()
