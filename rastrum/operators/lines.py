"""Rasters as lines: one row per line, parts as arrays; whole lines stay together.

Work along a line runs in Arrow batches; the other axis is reached by a corner
turn, one shuffle of tiles.  A tile holds what some lines have in ``TILE``
columns, so a shuffle moves few large records and a task gathers no more than
``TILE`` columns of the raster at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "row long, re array<double>, im array<double>"
TILE = 32
#: Samples that one Arrow batch holds at most.
BLOCK = 1 << 22


def _block(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = b["row"].to_numpy(zero_copy_only=False)
    re, im = (b[c].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) for c in ("re", "im"))
    return rows, re + 1j * im


def _batch(rows: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    block = np.ascontiguousarray(block, np.complex128)
    ends = pa.array(np.arange(len(rows) + 1) * block.shape[1], pa.int32())
    parts = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(p).ravel())) for p in (block.real, block.imag)]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *parts], names=["row", "re", "im"])


def _cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if len(b):
        step = max(1, BLOCK // max(1, len(b["re"][0])))
        for at in range(0, len(b), step):
            yield b.slice(at, step)


def map_lines(lines: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``f(rows, block)`` of blocks of whole lines gives as many lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _cut(whole):
                rows, block = _block(b)
                yield _batch(rows, f(rows, block))

    return lines.mapInArrow(run, LINE)


def corner_turn(lines: DataFrame, tile: int = TILE) -> DataFrame:
    """The transposed raster's lines."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _cut(whole):
                rows, block = _block(b)
                at = range(0, block.shape[1], tile)
                data = [np.ascontiguousarray(block[:, a : a + tile]).tobytes() for a in at]
                yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([rows.astype(np.int64).tobytes()] * len(at), pa.binary()), pa.array(data, pa.binary())], names=["col", "rows", "data"])

    def gather(table: pa.Table) -> pa.Table:
        col = table["col"][0].as_py()
        rows = [np.frombuffer(r.as_py(), np.int64) for r in table["rows"]]
        blocks = [np.frombuffer(d.as_py(), np.complex128).reshape(len(r), -1) for r, d in zip(rows, table["data"], strict=True)]
        turned = np.concatenate(blocks)[np.argsort(np.concatenate(rows))].T
        return pa.Table.from_batches([_batch(col + np.arange(len(turned)), turned)])

    return lines.mapInArrow(cut, "col long, rows binary, data binary").groupBy("col").applyInArrow(gather, LINE)


def from_numpy(spark: SparkSession, raster: np.ndarray, parts: int = 8) -> DataFrame:
    """Lines of a host array."""
    raster = np.atleast_2d(raster)
    return spark.createDataFrame(pa.Table.from_batches([_batch(np.arange(len(raster)), raster)])).repartitionByRange(parts, "row")


def to_numpy(lines: DataFrame) -> np.ndarray:
    """A host array; for rasters that fit the driver."""
    got = lines.toArrow().combine_chunks()
    if not len(got):
        return np.zeros((0, 0), complex)
    rows, block = _block(got.to_batches()[0])
    return block[np.argsort(rows)]


def from_cells(cells: DataFrame) -> DataFrame:
    """Lines of (i, j, re, im) with every j; a task gathers one line at once."""
    gathered = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "re", "im"))).alias("x"))
    return gathered.select(F.col("i").alias("row"), F.col("x.re").cast("array<double>").alias("re"), F.col("x.im").cast("array<double>").alias("im"))


def to_cells(lines: DataFrame) -> DataFrame:
    """(i, j, re, im)."""
    return lines.select(F.col("row").alias("i"), F.posexplode(F.arrays_zip("re", "im")).alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), "x.re", "x.im")


def scale(n: int, norm: str | None, inverse: bool) -> float:
    """What numpy's convention divides by."""
    return {None: 1.0 / n if inverse else 1.0, "backward": 1.0 / n if inverse else 1.0, "ortho": n**-0.5, "forward": 1.0 if inverse else 1.0 / n}[norm]


def fft(lines: DataFrame, norm: str | None = None) -> DataFrame:
    return map_lines(lines, lambda rows, x: np.fft.fft(x, axis=1, norm=norm))


def ifft(lines: DataFrame, norm: str | None = None) -> DataFrame:
    return map_lines(lines, lambda rows, x: np.fft.ifft(x, axis=1, norm=norm))


def kernel_taps(positions: np.ndarray, kernel: str, taps: int, window: str, beta: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source index, weight) of each tap for an array of finite positions."""
    floor = np.floor(positions)
    if kernel == "nearest":
        yield np.floor(positions + 0.5), np.ones_like(positions)
        return
    s = positions - floor
    if kernel == "linear":
        yield floor, 1 - s
        yield floor + 1, s
    elif kernel == "cubic":  # Keys' kernel with a = -1/2
        yield floor - 1, ((-0.5 * s + 1.0) * s - 0.5) * s
        yield floor, (1.5 * s - 2.5) * s * s + 1.0
        yield floor + 1, ((-1.5 * s + 2.0) * s + 0.5) * s
        yield floor + 2, (0.5 * s - 0.5) * s * s
    else:
        half = taps // 2
        for k in range(1 - half, half + 1):
            d = s - k
            t = np.minimum(np.abs(d / half), 1.0)
            shape = {"rect": lambda: np.ones_like(t), "hann": lambda: 0.5 + 0.5 * np.cos(np.pi * t), "hamming": lambda: 0.54 + 0.46 * np.cos(np.pi * t), "kaiser": lambda: np.i0(beta * np.sqrt(1 - t * t)) / np.i0(beta)}[window]()
            yield floor + k, np.sinc(d) * shape


def interpolate(block: np.ndarray, positions: np.ndarray, kernel: str = "sinc", taps: int = 8, window: str = "hann", beta: float = 2.5, boundary: str = "zero") -> np.ndarray:
    """Each line at its own positions (in samples); not finite or beyond 2 ** 62: zero."""
    n = block.shape[1]
    fine = np.isfinite(positions) & (np.abs(positions) < 2.0**62)
    safe = np.where(fine, positions, 0.0)
    out = np.zeros(positions.shape, np.complex128)
    for at, weight in kernel_taps(safe, kernel, taps, window, beta):
        if boundary == "zero":
            inside = (at >= 0) & (at < n)
        elif boundary == "edge":
            inside = np.ones(at.shape, bool)
        else:
            at, inside = np.mod(at, 2 * n), np.ones(at.shape, bool)
            at = np.where(at >= n, 2 * n - 1 - at, at)
        source = np.clip(at, 0, n - 1).astype(np.int64)
        out += np.where(inside, weight, 0.0) * np.take_along_axis(block, source, axis=1)
    return np.where(fine, out, 0.0)
