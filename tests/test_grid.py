import pytest

from meshwright.plans.grid import Grid, resolve


def test_defaults_and_resolution():
    assert resolve((0, 0, 5, 10)).shape == (256, 128)
    assert resolve((0, 0, 10, 10), resolution=0.5).shape == (20, 20)
    assert resolve((0, 0, 10, 10), resolution=(0.5, 1.0)).shape == (10, 20)
    assert resolve((0, 0, 10, 10), resolution=3.0).shape == (4, 4)


@pytest.mark.parametrize(("how", "message"), [({"shape": (2, 2), "resolution": 1.0}, "not both"), ({"resolution": 0.0}, "positive"), ({"shape": (0, 2)}, "positive")])
def test_refusals(how, message):
    with pytest.raises(ValueError, match=message):
        resolve((0, 0, 1, 1), **how)
    with pytest.raises(ValueError, match="extent"):
        resolve((1, 0, 1, 1))


def test_windows_and_tiles():
    g = Grid(0, 0, 10, 10, 10, 10)
    assert g.window(2.5, 3, 5, 7) == (4, 7, 3, 5)
    assert g.sub(4, 7, 3, 5).bounds == (2, 3, 5, 7)
    assert g.window(20, 20, 30, 30) is None
    assert sum(t.ncol * t.nrow for _, _, t in g.subdivide(4)) == 100
    assert g.transform() == (1, 0, 0, 0, -1, 10)
    assert g.cell_box(10, 10) == (9, 0, 10, 1)
    a, b = Grid(0, 0, 4, 4, 4, 4), Grid(2, 2, 6, 6, 4, 4)
    assert a.common(b).bounds == (0, 0, 6, 6) and a.overlap(b).shape == (2, 2) and a.compatible_with(b)
    assert a.overlap(Grid(10, 10, 12, 12, 2, 2)) is None and g.offsets(g.sub(4, 7, 3, 5)) == (3, 2)


def test_padding_comes_and_goes():
    g = Grid(0, 0, 10, 5, 20, 10)
    wide = g.padded(2)
    assert wide == Grid(-1, -1, 11, 6, 24, 14) and wide.padded(-2) == g and wide.offsets(g) == (2, 2) and wide.compatible_with(g)
    with pytest.raises(ValueError, match="empty"):
        g.padded(-5)
