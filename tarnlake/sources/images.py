"""Volumes from files: NIfTI-1 through Spark's binaryFile source, listings and manifests of folders."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# NIfTI-1 data type codes and numpy's names.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}

VOLUME = "path string, shape array<int>, spacing array<double>, affine array<double>, data array<double>, error string"
_volume = pa.schema([("path", pa.string()), ("shape", pa.list_(pa.int32())), ("spacing", pa.list_(pa.float64())), ("affine", pa.list_(pa.float64())), ("data", pa.list_(pa.float64())), ("error", pa.string())])


def decode_nifti(content: bytes) -> tuple[np.ndarray, list[float], np.ndarray]:
    """Values (scaled as the header says), voxel spacing and the 4 x 4 affine of a NIfTI-1 file, gzipped or not."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    for order in "<>":
        if struct.unpack(f"{order}i", content[:4])[0] == 348:
            break
    else:
        raise ValueError("no NIfTI-1 header")
    dims = struct.unpack(f"{order}8h", content[40:56])
    shape = [max(1, d) for d in dims[1 : 1 + dims[0]]]
    code = struct.unpack(f"{order}h", content[70:72])[0]
    if code not in TYPES:
        raise ValueError(f"data type {code}")
    spacing = list(struct.unpack(f"{order}8f", content[76:108])[1 : 1 + dims[0]])
    offset, slope, shift = struct.unpack(f"{order}3f", content[108:120])
    data = np.frombuffer(content, np.dtype(TYPES[code]).newbyteorder(order), int(np.prod(shape)), int(offset)).reshape(shape, order="F").astype(float)
    if slope:
        data = data * slope + shift
    form = struct.unpack(f"{order}h", content[254:256])[0]
    affine = np.diag([*(spacing + [1.0, 1.0, 1.0])[:3], 1.0])
    if form > 0:
        affine = np.vstack([np.array(struct.unpack(f"{order}12f", content[280:328])).reshape(3, 4), [0, 0, 0, 1]])
    return data, spacing, affine


def encode_nifti(data: np.ndarray, affine: np.ndarray | None = None, spacing: list[float] | None = None) -> bytes:
    """A gzipped NIfTI-1 file of 32-bit floats."""
    head = bytearray(352)
    spacing = list(spacing or [1.0] * data.ndim)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, *[1.0] * (7 - data.ndim))
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    if affine is not None:
        struct.pack_into("<h", head, 254, 1)
        struct.pack_into("<12f", head, 280, *np.asarray(affine, float)[:3].ravel())
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + np.asfortranarray(data, dtype="<f4").tobytes(order="F"), mtime=0)


def _decode(batches: Iterator[pa.RecordBatch], decode: Callable[[bytes], tuple]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                data, spacing, affine = decode(content.as_py())
                row = (path, list(data.shape), spacing, affine.ravel().tolist(), data.ravel(), None)
            except (ValueError, struct.error, zlib.error, OSError, EOFError) as e:  # a bad file is a row with its error, as in a batch report
                row = (path, None, None, None, None, str(e))
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _volume, strict=True)], schema=_volume)


def decoded(files: DataFrame, decode: Callable[[bytes], tuple] = decode_nifti) -> DataFrame:
    """Volumes of a binaryFile table, one row a file; data is in C order. A file that can't be read has its error instead. decode: from content to values, spacing and affine."""
    return files.select("path", "content").mapInArrow(lambda batches: _decode(batches, decode), VOLUME)


def read_volumes(spark: SparkSession, path: str, glob: str = "*.nii*", recursive: bool = False) -> DataFrame:
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path))


def stream_volumes(spark: SparkSession, path: str, glob: str = "*.nii*") -> DataFrame:
    """The same as files arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return decoded(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.nii\.gz|\.[^./\\]+)$", 1))


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, hashes: bool = False) -> DataFrame:
    """path, name, suffix, bytes and, if asked for, md5 and sha256 of each file; content isn't read otherwise."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    made = [F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")] if hashes else []
    return files.select("path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"), suffix(F.col("path")).alias("suffix"), F.col("length").alias("bytes"), *made)


def manifest(files: DataFrame) -> DataFrame:
    """Per suffix, and over all (null): files, bytes and megabytes."""
    return files.rollup("suffix").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / 1048576, 2).alias("megabytes"))


def structure_report(files: DataFrame, expected: list[str]) -> DataFrame:
    """Whether each expected name is there."""
    wanted = files.sparkSession.createDataFrame([(x,) for x in expected], "name string")
    return wanted.join(files.select("name").distinct().withColumn("present", F.lit(True)), "name", "left").select("name", F.coalesce("present", F.lit(False)).alias("present"))


def batch_report(results: DataFrame, error: str = "error") -> DataFrame:
    """Per suffix, and over all (null): files, those that failed, and the share that did not."""
    own = results.select(suffix(F.col("path")).alias("suffix"), F.col(error).isNotNull().cast("int").alias("failed"))
    return own.rollup("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("n_failed"), (1 - F.avg("failed")).alias("success_rate"))
