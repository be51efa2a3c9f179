"""DICOM slices and volumes: round trips in every transfer syntax, hand-made elements, broken files."""

import struct

import numpy as np
import pytest

from tarnlake.sources import dicom


@pytest.mark.parametrize("syntax", sorted(dicom.SYNTAXES))
def test_round_trip(syntax):
    pixels = np.arange(-6, 6).reshape(3, 4) * 100
    b = dicom.encode_dicom(pixels, "1.2.3", 7, (1.5, -2.0, 30.25), spacing=(0.5, 0.75), thickness=2.5, patient="p 1", syntax=syntax, slope=2.0, intercept=-10.0)
    got = dicom.decode_dicom(b)
    assert got["shape"] == [3, 4] and got["data"].reshape(3, 4).tolist() == pixels.tolist()
    assert (got["series"], got["instance"], got["patient_id"], got["modality"]) == ("1.2.3", 7, "p 1", "CT")
    assert got["position"] == [1.5, -2.0, 30.25] and got["pixel_spacing"] == [0.5, 0.75] and got["slice_thickness"] == 2.5
    assert dicom.decode_dicom(b, rescale=True)["data"].tolist() == (pixels.ravel() * 2.0 - 10).tolist()


def test_sequences_are_skipped():
    b = dicom.encode_dicom(np.ones((2, 2)), "9", 1)
    head, body = b[:132], b[132:]
    meta = 8 + struct.unpack("<H", body[6:8])[0]
    item = struct.pack("<2HI", 0xFFFE, 0xE000, 0xFFFFFFFF)
    end = struct.pack("<2HI", 0xFFFE, 0xE00D, 0) + struct.pack("<2HI", 0xFFFE, 0xE0DD, 0)
    sequence = struct.pack("<2H", 0x0008, 0x1140) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF)
    trap = struct.pack("<2H", 0x0020, 0x0013) + b"IS" + struct.pack("<H", 2) + b"99"  # an instance number of something else
    nested = (sequence + item) * 2000 + trap + end * 2000
    defined = struct.pack("<2H", 0x0008, 0x1111) + b"SQ\0\0" + struct.pack("<I", 8 + len(trap)) + struct.pack("<2HI", 0xFFFE, 0xE000, len(trap)) + trap
    unknown = struct.pack("<2H", 0x0009, 0x1001) + b"UN\0\0" + struct.pack("<I", 0xFFFFFFFF) + item + struct.pack("<2HI", 0x0009, 0x1002, 2) + b"ab" + end
    got = dicom.decode_dicom(head + body[:meta] + nested + defined + unknown + body[meta:])
    assert got["instance"] == 1 and got["data"].tolist() == [1.0] * 4


def test_color_and_frames():
    pixels = np.arange(2 * 2 * 3).astype("<u1")
    plain = dicom.encode_dicom(np.zeros((2, 2)), "9", 1)
    at = plain.index(struct.pack("<2H", *dicom.PIXELS))
    us = lambda tag, v: struct.pack("<2H", *tag) + b"US" + struct.pack("<2H", 2, v)
    body = plain[:at] + us(dicom.TAGS["samples"], 3) + us(dicom.TAGS["planar"], 1) + us(dicom.TAGS["bits"], 8) + us(dicom.TAGS["signed"], 0) + struct.pack("<2H", *dicom.PIXELS) + b"OB\0\0" + struct.pack("<I", 12) + pixels.tobytes()
    got = dicom.decode_dicom(body)
    assert got["shape"] == [2, 2, 3] and got["data"].reshape(2, 2, 3)[0, 1].tolist() == [1.0, 5.0, 9.0]


def test_volumes_and_broken_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    whole = rng.integers(-1000, 3000, (5, 4, 6))
    for z in range(5):  # instance numbers against the positions
        (tmp_path / f"s{z}.dcm").write_bytes(dicom.encode_dicom(whole[z], "1.9", 5 - z, (1.0, 2.0, 3.0 * z), spacing=(0.5, 0.7), thickness=2.0))
        (tmp_path / f"t{z}.dcm").write_bytes(dicom.encode_dicom(whole[z], "1.10", 5 - z))  # one position: by instance number
    good = dicom.encode_dicom(whole[0], "1.11", 1)
    (tmp_path / "cut.dcm").write_bytes(good[:-10])
    (tmp_path / "none.dcm").write_bytes(b"not an image")
    (tmp_path / "jpeg.dcm").write_bytes(good.replace(b"1.2.840.10008.1.2.1\0", b"1.2.840.10008.1.2.4\0"))
    (tmp_path / "u0.dcm").write_bytes(dicom.encode_dicom(whole[0], "1.12", 1))
    (tmp_path / "u1.dcm").write_bytes(dicom.encode_dicom(whole[1][:2], "1.12", 2))
    slices = dicom.read_slices(spark, str(tmp_path), "*.dcm")
    bad = {r["path"].rsplit("/", 1)[1]: r["error"] for r in slices.filter("error is not null").collect()}
    assert set(bad) == {"cut.dcm", "none.dcm", "jpeg.dcm"} and "compressed" in bad["jpeg.dcm"]
    got = {r["series"]: r for r in dicom.volumes(slices).collect()}
    assert got["1.9"]["shape"] == [5, 4, 6] and got["1.9"]["data"] == whole.ravel().tolist() and got["1.9"]["spacing"] == [3.0, 0.5, 0.7]
    assert got["1.9"]["affine"] == [0.5, 0, 0, 1.0, 0, 0.7, 0, 2.0, 0, 0, 2.0, 0.0, 0, 0, 0, 1.0]
    assert got["1.10"]["data"] == whole[::-1].ravel().tolist() and got["1.10"]["spacing"][0] == 1.0
    assert got["1.12"]["data"] is None and "unequal" in got["1.12"]["error"] and set(got) == {"1.9", "1.10", "1.12"}
