"""Headers made byte by byte."""

import struct

import numpy as np
import pytest

from filigree.sources import headers


def tiff(order="<", big=False, x=(50000, 10000), y=(20000, 10000), description=None, metadata=None, cut=None, kind=5):
    """A file with a directory behind its values, as writers of stacks leave it."""
    entries, blob = [], bytearray(b"\0" * (16 if big else 8))

    def put(tag, kind, count, data):
        room = 8 if big else 4
        if len(data) > room:
            place = struct.pack(order + ("Q" if big else "I"), len(blob))
            blob.extend(data + b"\0" * (len(data) % 2))
        else:
            place = data.ljust(room, b"\0")
        entries.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, count) + place)

    if description is not None:
        put(270, 2, len(description) + 1, description.encode("latin-1") + b"\0")
    for tag, value in ((282, x), (283, y)):
        if value is not None:
            put(tag, kind, 1, struct.pack(order + "II", *value))
    if metadata is not None:
        body = metadata.encode("utf-16-le" if order == "<" else "utf-16-be")
        head = b"IJIJ" if order == ">" else b"JIJI"
        head += struct.pack(order + "4sI", b"info" if order == ">" else b"ofni", 1)
        put(50838, 4, 2, struct.pack(order + "II", len(head), len(body)))
        put(50839, 1, len(head) + len(body), head + body)
    at = len(blob)
    blob += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + b"\0" * 8
    mark = b"II" if order == "<" else b"MM"
    blob[: 16 if big else 8] = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return bytes(blob[:cut])


def lif(*images):
    elements = "".join("<Element><Data><Image><ImageDescription><Dimensions>" + "".join(f'<DimensionDescription DimID="{i}" NumberOfElements="{n}" Length="{length}" Unit="m"/>' for i, n, length in dims) + "</Dimensions></ImageDescription></Image></Data></Element>" for dims in images)
    text = f'<LMSDataContainerHeader><Element Name="all"><Children>{elements}</Children></Element></LMSDataContainerHeader>'.encode("utf-16-le")
    return struct.pack("<iicI", 0x70, 5 + len(text), b"*", len(text) // 2) + text + b"pixels"


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff(order, big):
    assert headers.tiff_steps(tiff(order, big, description="ImageJ=1.53\nspacing=2.5\nloop=false")) == (2.5, 0.5, 0.2)
    assert headers.tiff_steps(tiff(order, big, metadata="Info\nnscales=1,1,4.5\nunit=um")) == (4.5, 0.5, 0.2)
    both = tiff(order, big, metadata="nscales=1,1,x", description="spacing=3loop")
    assert headers.tiff_steps(both) == (3.0, 0.5, 0.2)
    assert headers.tiff_steps(tiff(order, big, x=None)) == (None, 0.5, 0.5)
    assert headers.tiff_steps(tiff(order, big, y=None)) == (None, 0.2, 0.2)
    assert headers.tiff_steps(tiff(order, big, x=None, y=None, description="spacing=1e0\nloop")) == (1.0, None, None)
    assert headers.tiff_steps(tiff(order, big, description="no spacing here")) == (None, 0.5, 0.2)
    assert headers.tiff_steps(tiff(order, big, kind=10)) == (None, 0.5, 0.2)


@pytest.mark.parametrize("content", [b"", b"II", b"XX*\0\x08\0\0\0", b"II\x2c\0\x08\0\0\0", b"II*\0\xff\xff\0\0", tiff(x=(0, 1)), tiff(x=(1, 0)), tiff(description="long " * 20)[:60], tiff("<", True)[:30]])
def test_unreadable_tiff_has_no_sizes(content):
    assert headers.tiff_steps(content) == (None, None, None)


def test_lif():
    two = lif([(1, 101, 1e-4), (2, 11, 2e-5), (3, 5, -8e-6)], [(1, 101, 1e-4)], [(2, 1, 0.0), (3, 3, 0.0)])
    assert headers.lif_steps(two, 0) == pytest.approx((2.0, 2.0, 1.0))
    assert headers.lif_steps(two, 1) == (None, pytest.approx(1.0), pytest.approx(1.0))
    assert headers.lif_steps(two, 2) == headers.lif_steps(two, 3) == headers.lif_steps(two, -1) == (None, None, None)
    assert headers.lif_steps(b"junk", 0) == headers.lif_steps(two[:40], 0) == headers.lif_steps(b"", 0) == (None, None, None)


def test_sizes_of_files(spark, tmp_path):
    (tmp_path / "a.TIF").write_bytes(tiff(description="spacing=2loop"))
    (tmp_path / "b.lif").write_bytes(lif([(1, 3, 4e-6)], [(2, 3, 6e-6), (3, 2, 1e-6)]))
    (tmp_path / "c.tiff").write_bytes(b"not one")
    (tmp_path / "d.png").write_bytes(tiff())
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path AS file_path", "explode(array(0, 1)) AS image_index", "content")
    got = {(r["file_path"][-5:], r["image_index"]): r["voxel"] and tuple(r["voxel"]) for r in headers.voxel_sizes(files).collect()}
    assert got["a.TIF", 0] == got["a.TIF", 1] == (2.0, 0.5, 0.2, 0.35)
    assert got["b.lif", 0] == (None, pytest.approx(2.0), pytest.approx(2.0), pytest.approx(2.0)) and got["b.lif", 1] == pytest.approx((1.0, 3.0, 3.0, 3.0))
    assert got[".tiff", 0] == got["d.png", 0] == (None, None, None, None)


def test_axes():
    assert headers.lif_stack(np.zeros((5, 6))).shape == (1, 5, 6) and headers.lif_stack(np.zeros((63, 5, 6))).shape == (63, 5, 6)
    assert headers.lif_stack(np.zeros((64, 5, 6))).shape == (1, 64, 5, 6)
    a = np.arange(2 * 7 * 5 * 6).reshape(2, 7, 5, 6)
    assert (headers.lif_stack(a, 9) == a[1]).all() and (headers.lif_stack(np.moveaxis(a, 0, 3), 0) == a[0]).all()
    assert headers.lif_stack(np.zeros((9, 8, 7, 6)), 2).shape == (9, 8, 7)
    with pytest.raises(ValueError, match="axes"):
        headers.lif_stack(np.zeros((1,) * 5))
    assert headers.tiff_stack(np.zeros((40, 40, 3)))[1] and headers.tiff_stack(np.zeros((40, 40)))[1]
    assert not headers.tiff_stack(np.zeros((40, 32, 3)))[1] and not headers.tiff_stack(np.zeros((9, 40, 40)))[1]
    assert headers.tiff_stack(a, 1)[0].shape == (7, 5, 6)
