import random

import pytest

from scholia.operators import layout


def flood(pixels):
    left, out = set(pixels), []
    for start in sorted(left, key=lambda p: (p[1], p[0])):
        if start not in left:
            continue
        stack, own = [start], set()
        left.discard(start)
        while stack:
            x, y = stack.pop()
            own.add((x, y))
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            stack += near
        xs, ys = zip(*own, strict=True)
        out.append((min(xs), min(ys), max(xs), max(ys), len(own)))
    return out


@pytest.mark.parametrize("share", [0.15, 0.42])
def test_regions_are_those_of_a_flood(spark, share):
    rnd = random.Random(int(share * 100))
    images = {n: {(x, y) for x in range(130) for y in range(12) if rnd.random() < share} for n in range(2)}
    images[7] = {(x, 0) for x in range(400)} | {(399, y) for y in range(9)} | {(x, 9) for x in range(398, 100, -1)}  # one long line with corners
    rows = [(n, x, y) for n, own in images.items() for x, y in own]
    got = layout.ink_components(spark.createDataFrame([*rows, rows[0], (1, None, 3), (1, 3, None)], "image long, x long, y long"), "image").collect()
    for n, own in images.items():
        assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["n"]) for r in sorted(got, key=lambda r: r["label"]) if r["image"] == n] == flood(own)


def test_no_ink(spark):
    assert layout.ink_components(spark.createDataFrame([], "image long, x long, y long"), "image").count() == 0
