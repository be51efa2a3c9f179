"""Files written by hand, byte by byte, and what can't be read."""

import bz2
import gzip

import numpy as np

from tarnlake.sources import nrrd


def test_files(spark, tmp_path):
    a = np.arange(24).reshape(2, 3, 4)
    places = "space: left-posterior-superior\nspace directions: (0,2,0) (3,0,0) (0,0,4)\nspace origin: (10,20,30)\n"
    head = "NRRD0004\n# said: by hand\ntype: {}\ndimension: 3\n{}sizes: 2 3 4\nendian: {}\nencoding: {}\nnote:=a: b\n\n"

    def write(name, kind, order, encoding, body, more=places):
        (tmp_path / name).write_bytes(head.format(kind, more, order, encoding).encode() + body)

    raw = [a[i, j, k] for k in range(4) for j in range(3) for i in range(2)]  # the first axis is the fastest
    write("big.nrrd", "short", "big", "raw", b"".join(int(x).to_bytes(2, "big") for x in raw))
    write("packed.nrrd", "unsigned char", "little", "gzip", gzip.compress(bytes(raw)))
    write("bzip.nrrd", "float", "little", "bzip2", bz2.compress(np.array(raw, "<f4").tobytes()))
    write("text.nrrd", "int", "little", "ascii", " ".join(map(str, raw)).encode(), "spacings: 2 3 0.5\n")
    write("skipped.nrrd", "uint8", "little", "raw", b"junk" + bytes(raw), "byte skip: -1\n")
    write("short.nrrd", "double", "little", "raw", bytes(9))
    write("words.nrrd", "int", "little", "text", b"1 2 3")
    write("block.nrrd", "block", "little", "raw", bytes(24))
    write("hex.nrrd", "int", "little", "hex", bytes(24))
    write("apart.nrrd", "int", "little", "raw", b"", "data file: other.raw\n")
    write("torn.nrrd", "uint8", "little", "gzip", gzip.compress(bytes(raw))[:-9])
    packed = bytearray(gzip.compress(bytes(raw)))
    packed[12:16] = b"\xff\xff\xff\xff"
    write("spoilt.nrrd", "uint8", "little", "gzip", bytes(packed))
    (tmp_path / "other.nrrd").write_bytes(b"no header")
    (tmp_path / "empty.nrrd").write_bytes(b"")
    (tmp_path / "bare.nrrd").write_bytes(b"NRRD0001\n\n")
    got = {r["path"].rsplit("/", 1)[1].split(".")[0]: r for r in nrrd.read_volumes(spark, str(tmp_path)).collect()}
    good = {"big", "packed", "bzip", "text", "skipped"}
    assert {k for k, r in got.items() if r["error"] is None} == good and len(got) == 14 and "empty" not in got
    for k in good:
        assert got[k]["shape"] == [2, 3, 4] and np.array_equal(np.array(got[k]["data"]).reshape(2, 3, 4), a), k
    assert got["big"]["spacing"] == [2, 3, 4] and np.array_equal(np.array(got["big"]["affine"]).reshape(4, 4), [[0, -3, 0, -10], [-2, 0, 0, -20], [0, 0, 4, 30], [0, 0, 0, 1]])
    assert got["text"]["spacing"] == [2, 3, 0.5] and np.array_equal(np.array(got["text"]["affine"]).reshape(4, 4), np.diag([2, 3, 0.5, 1]))
    assert "other file" in got["apart"]["error"] and "encoding" in got["hex"]["error"] and "missing" in got["bare"]["error"]
