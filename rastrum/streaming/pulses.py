"""Range compression of a stream of pulses; each line stands alone, so no state is kept."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from rastrum.operators.lines import map_lines
from rastrum.sources.params import RadarParams, band_windows


def range_compress(pulses: DataFrame, n: int, p: RadarParams) -> DataFrame:
    """For batch or streaming frames of lines."""
    reference = np.conj(np.fft.fft(np.roll(p.chirp_replica(n), -(n // 2)))) * np.fft.ifftshift(band_windows(n, p)[0])
    return map_lines(pulses, lambda rows, x: np.fft.ifft(np.fft.fft(x, axis=1) * reference, axis=1))
