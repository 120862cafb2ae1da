"""Acquisition parameters, axes and band windows."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from rastrum.functions.windows import hanning


@dataclass(frozen=True)
class RadarParams:
    c: float
    fc: float
    fs: float
    prf: float
    vr: float
    r0: float
    kr: float
    pulse_len: float
    t_shift: float

    @property
    def wavelength(self) -> float:
        return self.c / self.fc

    def doppler(self, n: int) -> np.ndarray:
        return np.fft.fftshift(np.fft.fftfreq(n, 1 / self.prf))

    def range_frequency(self, n: int) -> np.ndarray:
        return np.fft.fftshift(np.fft.fftfreq(n, 1 / self.fs))

    def fast_time(self, n: int) -> np.ndarray:
        return 2 * self.r0 / self.c - self.t_shift + np.arange(n) / self.fs

    def chirp_replica(self, n: int) -> np.ndarray:
        t = (np.arange(n) - n / 2) / self.fs
        return np.where(np.abs(t) <= self.pulse_len / 2, np.exp(1j * np.pi * self.kr * t**2), 0)


# An L-band spaceborne acquisition.
ALOS_PARAMS = RadarParams(c=299792458.0, fc=1269999750.06, fs=32e6, prf=2155.172, vr=7072.0, r0=843013.994, kr=-1.037e12, pulse_len=27e-6, t_shift=4800.0 / 32e6)


def alos_params(n: int) -> RadarParams:
    """For n range samples; a window too short for the recorded place of r0 has it in the middle."""
    p = ALOS_PARAMS
    fits = (p.t_shift + p.pulse_len / 2) * p.fs < n
    return p if fits else replace(p, t_shift=n / p.fs / 2)


def synthetic_params(n: int) -> RadarParams:
    """An airborne C-band geometry whose chirp and aperture fill 70 % of an n x n raster's bands."""
    c, fc, fs, prf, r0, fill = 299792458.0, 5.3e9, 32e6, 400.0, 20000.0, 0.7
    pulse = n / fs / 2
    return RadarParams(c, fc, fs, prf, prf * (fill * c / fc * r0 / (2 * n)) ** 0.5, r0, -fill * fs / pulse, pulse, n / fs / 2)


def band_window(n: int, share: float) -> np.ndarray:
    """Hann over the middle ``share`` of a centred axis."""
    m = max(4, min(n, round(n * share)))
    lead = (n - m) // 2
    return np.pad(hanning(m), (lead, n - m - lead))


def band_windows(n: int, p: RadarParams) -> tuple[np.ndarray, np.ndarray]:
    """Of range and of azimuth."""
    span = 2 * p.vr**2 * n / p.prf / (p.wavelength * p.r0)
    return band_window(n, min(1.0, abs(p.kr) * p.pulse_len / p.fs)), band_window(n, min(1.0, span / p.prf))
