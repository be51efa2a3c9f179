"""Volumes in NRRD files: raw, gzip, bzip2 and text encodings, read from and written as tables of files.

The first axis of a file is the fastest; data of a row is in C order of the same axes, as of other volumes. World places are right, anterior, superior: files of other spaces have the axes that differ turned.
A file with its data elsewhere, of block type, or shorter than its header says is a row with its error; Spark's source leaves out files without a byte. An axis without direction (a list of values, as of vectors) is an axis of the shape alone.
"""

from __future__ import annotations

import bz2
import gzip
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnlake.sources.images import decoded

# Names of data types in files and numpy's names.
TYPES = {
    "signed char": "i1", "int8": "i1", "int8_t": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "uint8_t": "u1", "short": "i2", "short int": "i2", "signed short": "i2", "int16": "i2", "int16_t": "i2",
    "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint16_t": "u2", "int": "i4", "signed int": "i4", "int32": "i4", "int32_t": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "uint32_t": "u4",
    "longlong": "i8", "long long": "i8", "int64": "i8", "int64_t": "i8", "ulonglong": "u8", "unsigned long long": "u8", "uint64": "u8", "uint64_t": "u8", "float": "f4", "double": "f8",
}
# Names of spaces, and which world axes point the other way.
TURNED = {"right-anterior-superior": (1, 1, 1), "ras": (1, 1, 1), "left-anterior-superior": (-1, 1, 1), "las": (-1, 1, 1), "left-posterior-superior": (-1, -1, 1), "lps": (-1, -1, 1)}


def _vectors(text: str) -> list[list[float] | None]:
    return [None if v == "none" else [float(x) for x in v[1:-1].split(",")] for v in re.findall(r"none|\([^)]*\)", text)]


def _header(content: bytes) -> tuple[dict[str, str], int]:
    """Fields by lower-case name, and where the data begins."""
    if not re.match(rb"NRRD000\d", content):
        raise ValueError("no NRRD header")
    end = re.search(rb"\r?\n\r?\n", content)
    lines = content[: end.start() if end else len(content)].decode("latin-1").splitlines()[1:]
    fields = dict(line.split(": ", 1) for line in lines if ": " in line and not line.startswith("#") and ":=" not in line)
    return {k.strip().lower(): v.strip() for k, v in fields.items()}, end.end() if end else len(content)


def decode_nrrd(content: bytes) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Values, distances of voxels along the axes and the 4 x 4 affine."""
    fields, at = _header(content)
    if missing := {"type", "sizes", "encoding"} - set(fields):
        raise ValueError(f"missing fields: {', '.join(sorted(missing))}")
    if "data file" in fields or "datafile" in fields:
        raise ValueError("data in another file")
    kind, encoding = TYPES.get(fields["type"].lower()), fields["encoding"].lower()
    if kind is None:
        raise ValueError(f"data type {fields['type']}")
    shape = [int(n) for n in fields["sizes"].split()]
    n, order = int(np.prod(shape)), ">" if fields.get("endian", "little").lower() == "big" else "<"
    if encoding in ("text", "txt", "ascii"):
        flat = np.array(content[at:].split()[:n], dtype=float)
    else:
        opened = {"raw": bytes, "gzip": gzip.decompress, "gz": gzip.decompress, "bzip2": bz2.decompress, "bz2": bz2.decompress}
        if encoding not in opened:
            raise ValueError(f"encoding {encoding}")
        body = opened[encoding](content[at:])
        skip = int(fields.get("byte skip", fields.get("byteskip", 0)))
        width = n * np.dtype(kind).itemsize
        flat = np.frombuffer(body, np.dtype(kind).newbyteorder(order), n, len(body) - width if skip < 0 else skip).astype(float)
    if flat.size < n:
        raise ValueError(f"{flat.size} of {n} values")
    data = flat.reshape(shape, order="F")
    affine = np.eye(4)
    given = [v for v in _vectors(fields.get("space directions", "")) if v is not None]
    if given:
        turned = np.array(TURNED.get(fields.get("space", "").lower(), (1, 1, 1)), float)
        for k, v in enumerate(given[:3]):
            affine[:3, k] = (v + [0.0, 0.0])[:3] * turned
        origin = (_vectors(fields.get("space origin", "")) or [None])[0] or [0.0, 0.0, 0.0]
        affine[:3, 3] = (origin + [0.0, 0.0])[:3] * turned
        spacing = [float(np.linalg.norm(v)) for v in given]
    else:
        spacing = [float(x) if x.lower() != "nan" else 1.0 for x in fields.get("spacings", " ".join(["1"] * len(shape))).split()]
        affine[range(min(3, len(spacing))), range(min(3, len(spacing)))] = spacing[:3]
    return data, spacing, affine


def encode_nrrd(data: np.ndarray, affine: np.ndarray, encoding: str = "gzip") -> bytes:
    """A file of doubles of three axes; encoding: gzip or raw."""
    if encoding not in ("gzip", "raw"):
        raise ValueError(f"encoding {encoding}")
    vector = lambda v: "(" + ",".join(repr(float(x)) for x in v) + ")"
    head = ["NRRD0004", "type: double", f"dimension: {data.ndim}", "space: right-anterior-superior", f"sizes: {' '.join(map(str, data.shape))}", f"space directions: {' '.join(vector(affine[:3, k]) for k in range(3))}", f"space origin: {vector(affine[:3, 3])}", "endian: little", f"encoding: {encoding}"]
    body = np.asarray(data, "<f8").tobytes(order="F")
    return ("\n".join(head) + "\n\n").encode() + (gzip.compress(body, mtime=0) if encoding == "gzip" else body)


def encoded(volumes: DataFrame, encoding: str = "gzip") -> DataFrame:
    """path and content of a file for each row with path, shape, affine and data; rows without data have none."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, shape, affine, data in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                if not data.is_valid:
                    continue
                values = data.values.to_numpy(zero_copy_only=False).reshape(shape.as_py())
                content = encode_nrrd(values, np.array(affine.as_py()).reshape(4, 4), encoding)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([content], pa.binary())], schema=schema)

    return volumes.select("path", "shape", "affine", "data").mapInArrow(encode, "path string, content binary")


def read_volumes(spark: SparkSession, path: str, glob: str = "*.nrrd", recursive: bool = False) -> DataFrame:
    """path, shape, spacing, affine, data, error of each file."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path), decode_nrrd)
