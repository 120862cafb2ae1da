"""Point-target and scene quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.errors import TraceError


def upsample(line: np.ndarray, factor: int = 32) -> np.ndarray:
    """Zeros in the middle of the spectrum."""
    n = len(line)
    s = np.fft.fftshift(np.fft.fft(line))
    lead = (n * factor - n) // 2
    return np.fft.ifft(np.fft.ifftshift(np.pad(s, (lead, n * factor - n - lead)))) * factor


def measure_cut(line: np.ndarray, factor: int = 32) -> dict[str, float]:
    """IRW (samples), PSLR and ISLR (dB) of the line's peak."""
    x = np.abs(upsample(np.asarray(line), factor))
    top = int(np.argmax(x))
    half = x[top] / np.sqrt(2)

    def crossing(step: int) -> float:
        k = top
        while 0 < k < len(x) - 1 and x[k] > half:
            k += step
        return abs(k - top) - (half - x[k]) / (x[k - step] - x[k]) if x[k - step] != x[k] else abs(k - top)

    def minimum(step: int) -> int:
        k = top
        while 0 < k < len(x) - 1 and x[k + step] < x[k]:
            k += step
        return k

    left, right = minimum(-1), minimum(1)
    side = np.concatenate([x[:left], x[right + 1 :]])
    main = (x[left : right + 1] ** 2).sum()
    return {
        "irw": (crossing(-1) + crossing(1)) / factor,
        "pslr": 20 * np.log10((side.max() if len(side) else 0.0) / x[top] + 1e-30),
        "islr": 10 * np.log10((side**2).sum() / main + 1e-30),
    }


def peak(image: DataFrame) -> tuple[int, int]:
    """(row, column) of an image's largest sample, the first of equals."""
    each = image.select("row", F.array_max("re").alias("v"), (F.array_position("re", F.array_max("re")) - 1).alias("col"))
    best = each.agg(F.max(F.struct("v", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("x")).first()["x"]
    return -best["r"], -best["c"]


def measure_image(image: DataFrame, expected: tuple[float, float] | None = None) -> dict:
    """Cuts through the peak in both directions; two lines go to the driver."""
    row, col = peak(image)
    along = image.where(F.col("row") == row).select("re").first()["re"]
    across = [r["v"] for r in image.select("row", F.col("re")[col].alias("v")).orderBy("row").collect()]
    out = {"peak": (row, col), "range": measure_cut(np.array(along)), "azimuth": measure_cut(np.array(across))}
    if expected is not None:
        out["peak_error"] = (row - round(expected[0]), col - round(expected[1]))
    return out


def scene_contrast(cells: DataFrame, tile: int = 512, looks: int = 4) -> DataFrame:
    """Deviation over mean of the brightest ``tile`` x ``tile`` samples of the magnitude (i, j, v), multilooked.

    Looks and tiles that the image's edges cut are dropped; of equally bright
    tiles the first counts; null if no tile fits or its mean isn't positive."""
    if looks < 1 or tile < looks or tile % looks:
        raise TraceError(f"{looks} looks don't divide a tile of {tile}")
    across = tile // looks
    looked = cells.groupBy(F.floor(F.col("i") / looks).alias("i"), F.floor(F.col("j") / looks).alias("j")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    tiled = looked.where(F.col("n") == looks * looks).withColumns({"a": F.floor(F.col("i") / across), "b": F.floor(F.col("j") / across)})
    tiles = tiled.groupBy("a", "b").agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.when(F.avg("v") > 0, F.stddev_pop("v") / F.avg("v")).alias("contrast"))
    best = F.max(F.struct("total", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), "contrast"))
    return tiles.where(F.col("n") == across * across).agg(best["contrast"].alias("contrast"))


def db_image(cells: DataFrame, floor: float = -60.0) -> DataFrame:
    """(i, j, db) against the largest sample, cut off at ``floor``."""
    top = cells.agg(F.max("v").alias("top"))
    level = 20 * F.log10(F.col("v") / F.col("top") + 1e-12)
    return cells.join(F.broadcast(top)).select("i", "j", F.greatest(level, F.lit(floor)).alias("db"))  # one row


def stretched(cells: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(i, j, v) from 0 to 1 between two exact percentiles."""
    ends = cells.agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("e")).select(F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
    wide = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-30))
    return cells.join(F.broadcast(ends)).select("i", "j", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / wide)).alias("v"))  # one row
