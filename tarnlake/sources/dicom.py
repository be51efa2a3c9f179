"""DICOM slices from Spark's binaryFile source, and series of slices as volumes.

A file is parsed element by element: implicit and explicit little endian, explicit big endian, deflated; sequences, nested or of undefined length, are skipped. Compressed pixel data is an error. A file that
can't be read is a row with its error. Slices are rows; a series is one row, its slices in the order of their position along the normal of the image plane, or, where positions are missing or equal,
of instance number, then path. A volume has to fit a task, as every image here.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Transfer syntaxes (byte order, explicit, deflated), value representations with four-byte lengths, and tags.
SYNTAXES = {"1.2.840.10008.1.2": ("<", False, False), "1.2.840.10008.1.2.1": ("<", True, False), "1.2.840.10008.1.2.1.99": ("<", True, True), "1.2.840.10008.1.2.2": (">", True, False)}
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
TAGS = {
    "modality": (0x0008, 0x0060), "patient_id": (0x0010, 0x0020), "slice_thickness": (0x0018, 0x0050), "spacing_between": (0x0018, 0x0088), "study": (0x0020, 0x000D), "series": (0x0020, 0x000E),
    "instance": (0x0020, 0x0013), "position": (0x0020, 0x0032), "orientation": (0x0020, 0x0037), "samples": (0x0028, 0x0002), "planar": (0x0028, 0x0006), "frames": (0x0028, 0x0008), "rows": (0x0028, 0x0010),
    "columns": (0x0028, 0x0011), "pixel_spacing": (0x0028, 0x0030), "bits": (0x0028, 0x0100), "signed": (0x0028, 0x0103), "intercept": (0x0028, 0x1052), "slope": (0x0028, 0x1053),
}
SYNTAX, PIXELS, ITEM, ITEM_END, SEQUENCE_END = (0x0002, 0x0010), (0x7FE0, 0x0010), (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
UNDEFINED = 0xFFFFFFFF

SLICE = "path string, study string, series string, patient_id string, modality string, instance int, position array<double>, orientation array<double>, pixel_spacing array<double>, slice_thickness double, shape array<int>, data array<double>, error string"
_slice = pa.schema([
    ("path", pa.string()), ("study", pa.string()), ("series", pa.string()), ("patient_id", pa.string()), ("modality", pa.string()), ("instance", pa.int32()), ("position", pa.list_(pa.float64())), ("orientation", pa.list_(pa.float64())),
    ("pixel_spacing", pa.list_(pa.float64())), ("slice_thickness", pa.float64()), ("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float64())), ("error", pa.string()),
])


def _header(b: bytes, at: int, order: str, explicit: bool) -> tuple[tuple[int, int], bytes, int, int]:
    """Tag, representation, length and where the value starts."""
    tag = struct.unpack_from(f"{order}2H", b, at)
    if explicit and tag[0] != 0xFFFE:
        kind = b[at + 4 : at + 6]
        if kind in LONG:
            return tag, kind, struct.unpack_from(f"{order}I", b, at + 8)[0], at + 12
        return tag, kind, struct.unpack_from(f"{order}H", b, at + 6)[0], at + 8
    return tag, b"", struct.unpack_from(f"{order}I", b, at + 4)[0], at + 8


def _after_items(b: bytes, at: int, order: str, explicit: bool) -> int:
    """Where a sequence of undefined length ends. Open sequences and items are kept as a list, so depth is no matter."""
    open_: list[tuple[bool, bool]] = [(True, explicit)]  # (a sequence, else an item; explicit)
    while open_:
        in_sequence, kind_explicit = open_[-1]
        tag, kind, length, value = _header(b, at, order, kind_explicit)
        if tag == (SEQUENCE_END if in_sequence else ITEM_END):
            open_.pop()
            at = value
        elif in_sequence and tag != ITEM:
            raise ValueError(f"no item at byte {at}")
        elif length == UNDEFINED:
            open_.append((not in_sequence, kind_explicit and kind != b"UN"))
            at = value
        else:
            at = value + length
    return at


def elements(b: bytes) -> Iterator[tuple[tuple[int, int], bytes, str]]:
    """(tag, value, byte order) of the elements at the top, sequences left out."""
    at, order, explicit = (132, "<", True) if b[128:132] == b"DICM" else (0, "<", False)
    syntax = None
    while at + 8 <= len(b):
        tag, kind, length, value = _header(b, at, order, explicit)
        if syntax is not None and tag[0] != 2:  # the file's own header has ended
            if syntax not in SYNTAXES:
                raise ValueError(f"pixel data is compressed, transfer syntax {syntax}")
            order, explicit, deflated = SYNTAXES[syntax]
            syntax = None
            if deflated:
                b, at = zlib.decompress(b[at:], -15), 0
            continue
        if length == UNDEFINED:
            if tag == PIXELS:
                raise ValueError("pixel data is compressed")
            at = _after_items(b, value, order, explicit and kind != b"UN")
            continue
        if value + length > len(b):
            raise ValueError("file is cut short")
        if kind != b"SQ":
            found = b[value : value + length]
            if tag == SYNTAX:
                syntax = found.decode("ascii").strip("\0 ")
            yield tag, found, order
        at = value + length


def decode_dicom(b: bytes, rescale: bool = False) -> dict:
    """Identity, geometry, shape and pixels (C order, float) of one file. rescale: stored values times slope plus intercept."""
    names, raw, order = {t: n for n, t in TAGS.items()}, {}, "<"
    for tag, value, order in elements(b):
        if tag in names:
            raw[names[tag]] = value
        elif tag == PIXELS:
            raw["pixels"] = value
    text = lambda n: raw[n].decode("latin-1").strip("\0 ") or None if n in raw else None
    whole = lambda n, default=None: struct.unpack_from(f"{order}H", raw[n])[0] if n in raw else default

    def numbers(n: str) -> list[float] | None:
        return [float(x) for x in text(n).split("\\")] if text(n) else None

    if "pixels" not in raw:
        raise ValueError("no pixel data")
    rows, columns, bits = whole("rows"), whole("columns"), whole("bits")
    if not rows or not columns or bits not in {8, 16, 32}:
        raise ValueError(f"{rows} rows, {columns} columns, {bits} bits a pixel")
    frames, samples = int(text("frames") or 1), whole("samples", 1)
    n = rows * columns * frames * samples
    if len(raw["pixels"]) * 8 < n * bits:
        raise ValueError("pixel data is cut short")
    data = np.frombuffer(raw["pixels"], np.dtype(f"{order}{'i' if whole('signed', 0) else 'u'}{bits // 8}"), n).astype(float)
    shape = [rows, columns]
    if samples > 1 and whole("planar", 0):
        data = data.reshape(frames, samples, rows, columns).transpose(0, 2, 3, 1).ravel()
    if rescale:
        data = data * (numbers("slope") or [1.0])[0] + (numbers("intercept") or [0.0])[0]
    return {
        "study": text("study"), "series": text("series"), "patient_id": text("patient_id"), "modality": text("modality"), "instance": int(text("instance")) if text("instance") else None,
        "position": numbers("position"), "orientation": numbers("orientation"), "pixel_spacing": numbers("pixel_spacing"), "slice_thickness": (numbers("slice_thickness") or [None])[0],
        "shape": ([frames] if frames > 1 else []) + shape + ([samples] if samples > 1 else []), "data": data,
    }


def encode_dicom(pixels: np.ndarray, series: str, instance: int, position: tuple = (0.0, 0.0, 0.0), orientation: tuple = (1, 0, 0, 0, 1, 0), spacing: tuple = (1.0, 1.0), thickness: float = 1.0, patient: str = "", modality: str = "CT", syntax: str = "1.2.840.10008.1.2.1", slope: float = 1.0, intercept: float = 0.0) -> bytes:
    """A file of one slice of 16-bit signed values, in any of SYNTAXES."""
    order, explicit, deflated = SYNTAXES[syntax]

    def element(tag: tuple[int, int], kind: str, value: bytes, order: str = order, explicit: bool = explicit) -> bytes:
        value += (b"\0" if kind in {"UI", "OW", "OB"} else b" ") * (len(value) % 2)
        head = struct.pack(f"{order}2H", *tag)
        if not explicit:
            return head + struct.pack(f"{order}I", len(value)) + value
        return head + kind.encode() + (struct.pack(f"{order}HI", 0, len(value)) if kind.encode() in LONG else struct.pack(f"{order}H", len(value))) + value

    listed = lambda xs: "\\".join(f"{x:.10g}" for x in xs).encode()
    short = lambda x: struct.pack(f"{order}H", x)
    rows, columns = pixels.shape
    values = {
        "modality": ("CS", modality.encode()), "patient_id": ("LO", patient.encode()), "slice_thickness": ("DS", listed([thickness])), "series": ("UI", series.encode()), "instance": ("IS", str(instance).encode()),
        "position": ("DS", listed(position)), "orientation": ("DS", listed(orientation)), "samples": ("US", short(1)), "rows": ("US", short(rows)), "columns": ("US", short(columns)), "pixel_spacing": ("DS", listed(spacing)),
        "bits": ("US", short(16)), "signed": ("US", short(1)), "intercept": ("DS", listed([intercept])), "slope": ("DS", listed([slope])),
    }
    body = b"".join(element(TAGS[n], kind, v) for n, (kind, v) in values.items()) + element(PIXELS, "OW", pixels.astype(f"{order}i2").tobytes())
    if deflated:
        packer = zlib.compressobj(wbits=-15)
        body = packer.compress(body) + packer.flush()
    return b"\0" * 128 + b"DICM" + element(SYNTAX, "UI", syntax.encode(), "<", True) + body


def decoded_slices(files: DataFrame, rescale: bool = False) -> DataFrame:
    """A row for each row (path, content): see SLICE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    row = {"path": path, "error": None, **decode_dicom(content.as_py() or b"", rescale)}
                except (ValueError, struct.error, zlib.error, IndexError) as e:  # a bad file is a row with its error
                    row = {"path": path, "error": str(e) or type(e).__name__}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in _slice], schema=_slice)

    return files.select("path", "content").mapInArrow(run, SLICE)


def read_slices(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, rescale: bool = False) -> DataFrame:
    return decoded_slices(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path), rescale)


def volumes(slices: DataFrame) -> DataFrame:
    """(series, n_slices, shape, spacing, affine, data, error) of each series, from the slices that could be read and have a series.

    spacing: between slices along the normal (the thickness where positions don't tell), rows, columns. affine, 4 x 4 in rows: direction cosines of rows and columns times their spacing, the slice axis along z with the
    thickness, and the first slice's position. Slices of unequal shape make the series an error."""
    o = F.coalesce("orientation", F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)]))
    normal = F.array(o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3])
    along = F.aggregate(F.zip_with(F.col("position"), normal, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = slices.filter("error is null and series is not null").withColumn("along", along)
    per = rows.groupBy("series").agg(F.countDistinct("along").alias("places"), F.count(F.lit(1)).alias("n_slices"), F.countDistinct("shape").alias("shapes"), F.min("along").alias("low"), F.max("along").alias("high"))
    placed = rows.join(per, "series").withColumn("key", F.struct(F.when(F.col("places") == F.col("n_slices"), F.col("along")).alias("along"), F.coalesce("instance", F.lit(0)).alias("instance"), "path"))
    one = placed.groupBy("series").agg(
        F.first("n_slices").alias("n_slices"), F.first("shapes").alias("shapes"), F.first("places").alias("places"), F.first("low").alias("low"), F.first("high").alias("high"), F.min_by("shape", "key").alias("own"),
        F.min_by(F.struct(F.coalesce("pixel_spacing", F.array(F.lit(1.0), F.lit(1.0))).alias("p"), F.coalesce("slice_thickness", F.lit(1.0)).alias("t"), o.alias("o"), F.coalesce("position", F.array(*[F.lit(0.0)] * 3)).alias("at")), "key").alias("g"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("key", "data"))), lambda e: e["data"])).alias("data"),
    )
    p, t, d, at = (F.col(f"g.{n}") for n in ("p", "t", "o", "at"))
    gap = F.when((F.col("places") == F.col("n_slices")) & (F.col("n_slices") > 1), (F.col("high") - F.col("low")) / (F.col("n_slices") - 1)).otherwise(t)
    zero, unit = F.lit(0.0), F.lit(1.0)
    affine = F.array(p[0] * d[0], p[0] * d[1], p[0] * d[2], at[0], p[1] * d[3], p[1] * d[4], p[1] * d[5], at[1], zero, zero, t, at[2], zero, zero, zero, unit)
    whole = F.col("shapes") == 1
    return one.select("series", "n_slices", F.when(whole, F.concat(F.array(F.col("n_slices").cast("int")), "own")).alias("shape"), F.array(gap, p[0], p[1]).alias("spacing"), affine.alias("affine"), F.when(whole, F.col("data")).alias("data"), F.when(~whole, F.lit("slices of unequal shape")).alias("error"))
