"""CEOS products and flat binary rasters, read in parallel by line."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.errors import LaunchError
from rastrum.operators.lines import LINE, _batch

# Fixed values of the format.
DESCRIPTOR, PREFIX, SUMMARY = 720, 412, 4096
WAVELENGTH_AT, SAMPLING_AT, PRF_AT, FIELD = 501, 711, 935, 16


def parse_leader(leader: bytes, image_head: bytes | None = None, system_delay: float = 3.07e-5) -> dict[str, float | None]:
    """Carrier, sampling and pulse rates from a leader file; r0 from an image file's first line."""
    c, at, fields = 299792458.0, DESCRIPTOR, {}
    while at + 12 <= len(leader):
        size = struct.unpack_from(">I", leader, at + 8)[0]
        if size == SUMMARY:
            for name, place in (("wavelength", WAVELENGTH_AT), ("mhz", SAMPLING_AT), ("mhertz", PRF_AT)):
                try:
                    fields[name] = float(leader[at + place - 1 : at + place - 1 + FIELD])
                except ValueError:
                    fields[name] = None
            break
        at += max(size, 12)
    fs = fields["mhz"] * 1e6 if fields.get("mhz") else None
    prf = fields["mhertz"] / 1e3 if fields.get("mhertz") else None
    r0 = None
    if image_head is not None and prf:
        rank = struct.unpack_from(">H", image_head, DESCRIPTOR + 116)[0]
        delay = struct.unpack_from(">I", image_head, DESCRIPTOR + 120)[0]
        r0 = c / 2 * (rank / prf + delay * 1e-9 - system_delay)
    kr = -(28e6 if abs(fs - 32e6) < 1e5 else 14e6) / 27e-6 if fs else None
    return {"c": c, "fc": c / fields["wavelength"] if fields.get("wavelength") else None, "fs": fs, "prf": prf, "r0": r0, "kr": kr}


def _read_lines(spark: SparkSession, path: str, n: int, offset: int, stride: int, size: int, decode, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            for b in batches:
                for row in b["id"].to_pylist():
                    f.seek(offset + row * stride)
                    yield _batch(np.array([row]), decode(f.read(size))[None])

    return spark.range(0, n, 1, parts).mapInArrow(run, LINE)


def read_ceos_raw(spark: SparkSession, path: str, n_lines: int, n_samples: int, start: int = 0, width: int | None = None, parts: int = 8) -> DataFrame:
    """Lines of (I, Q) bytes after a prefix, without each channel's mean, filled with zeros to ``width``."""
    stride = PREFIX + 2 * n_samples
    as_complex = lambda raw: (lambda x: x[0::2] + 1j * x[1::2])(np.frombuffer(raw, np.uint8).astype(float))
    lines = _read_lines(spark, path, n_lines, DESCRIPTOR + start * stride + PREFIX, stride, 2 * n_samples, as_complex, parts)
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)) / (n_lines * n_samples)
    mean = lines.agg(total("re"), total("im")).first()
    fill = F.array_repeat(F.lit(0.0), max(0, (width or n_samples) - n_samples))

    def centred(name: str, by: float):
        return F.concat(F.transform(name, lambda x: x - by), fill).alias(name)

    return lines.select("row", *map(centred, ("re", "im"), mean))


def read_flat(spark: SparkSession, path: str, n_lines: int, n_samples: int, parts: int = 8) -> DataFrame:
    """A flat complex64 file of exactly that shape."""
    fs, at = pafs.FileSystem.from_uri(path)
    if (size := fs.get_file_info(at).size) != 8 * n_lines * n_samples:
        raise LaunchError(f"{path} has {size} bytes, not {8 * n_lines * n_samples}")
    return _read_lines(spark, path, n_lines, 0, 8 * n_samples, 8 * n_samples, lambda raw: np.frombuffer(raw, "<c8"), parts)
