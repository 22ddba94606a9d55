"""Labels of whole masks against a flood fill."""

import os

import pytest

from grainfield.plans import catalog
from grainfield.sources.views import SIDE, Relations

SF = "/root/testdata/sf0.001"


def filled(pixels):
    """Labels of one image's pixels (y, x), eight neighbours each, numbered in reading order."""
    left, out, n = set(pixels), {}, 0
    for start in sorted(pixels):
        if start in left:
            n += 1
            left.discard(start)
            todo = [start]
            while todo:
                y, x = todo.pop()
                out[y, x] = n
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
    return out


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_whole_mask_is_labelled(spark):
    images = {}
    for r in Relations(spark, SF).mask("v1", 1.4).collect():
        images.setdefault(r.img, []).append((r.y, r.x))
    want = {(img, *at, n) for img, px in images.items() for at, n in filled(px).items()}
    assert max(y for _, y, _, _ in want) == SIDE - 1
    found = {(r.img, r.y, r.x, r.label) for r in catalog.queries()["img_label_mask"](spark, SF).collect()}
    assert found == want
