"""Imaging chains, metrics, sources and streaming."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.errors import LaunchError, TraceError
from rastrum.operators import lines as L
from rastrum.plans import imaging, metrics
from rastrum.sources import ceos
from rastrum.sources.params import alos_params, band_windows, synthetic_params
from rastrum.sources.simulate import Geometry, demo_scene, stripmap_echo, target_pixel
from rastrum.streaming.pulses import range_compress


@pytest.mark.parametrize("chain", imaging.CHAINS)
def test_point_target(spark, chain):
    n = 128
    p = synthetic_params(n)
    image = imaging.CHAINS[chain](stripmap_echo(spark, n, p, [(0.0, 0.0, 1.0)]), n, p).cache()
    found = metrics.measure_image(image, target_pixel(n, p, (0.0, 0.0, 1.0)))
    assert found["peak_error"] == (0, 0)
    power = np.abs(L.to_numpy(image)) ** 2
    r, c = found["peak"]
    assert power[r - 3 : r + 4, c - 3 : c + 4].sum() / power.sum() > (0.8 if chain == "range_doppler" else 0.9)


def resampled(x, at):
    """Eight Hann-weighted sinc taps, one sample at a time; zero outside."""
    out = np.zeros(x.shape, complex)
    for (i, j), p in np.ndenumerate(np.broadcast_to(at, x.shape)):
        first = int(np.floor(p)) - 3
        for k in range(max(first, 0), min(first + 8, x.shape[1])):
            out[i, j] += x[i, k] * np.sinc(p - k) * np.cos(np.pi * min(abs(p - k) / 8, 0.5)) ** 2
    return out


def whole_scene(chain, raw, n, p):
    """The chains on one array, from their published phase functions."""
    forward = lambda x, axis: np.fft.fftshift(np.fft.fft(x, axis=axis), axes=axis)
    back = lambda x, axis: np.fft.ifft(np.fft.ifftshift(x, axes=axis), axis=axis)
    win_r, win_a = band_windows(n, p)
    eta, f, tau = p.doppler(n)[:, None], p.range_frequency(n)[None], p.fast_time(n)[None]
    if chain == "omega_k":
        x = forward(forward(raw, 1), 0)
        beyond = (p.c * eta / (2 * p.vr)) ** 2
        x = x * np.exp(1j * np.pi * f**2 / p.kr) * np.exp(4j * np.pi * p.r0 / p.c * (np.sqrt((p.fc + f) ** 2 - beyond) - p.fc - f))
        turn = np.exp(2j * np.pi * f * p.t_shift)
        x = resampled(x * turn, (np.sqrt((p.fc + f) ** 2 + beyond) - p.fc - f[0, 0]) / (f[0, 1] - f[0, 0])) / turn
        return np.abs(back(back(x * win_r * win_a[:, None], 1), 0))
    if chain == "range_doppler":
        replica = np.fft.fft(np.roll(p.chirp_replica(n), -(n // 2)))
        x = forward(np.fft.ifft(np.fft.fft(raw, axis=1) * replica.conj() * np.fft.ifftshift(win_r), axis=1), 0)
        bend = (p.wavelength * eta / p.vr) ** 2 / 8 * tau
        x = resampled(x, np.arange(n) + bend * p.fs) * np.exp(-2j * np.pi * bend * p.c / p.wavelength)
        return np.abs(back(x * win_a[:, None], 0))
    x = forward(raw, 0)
    d = np.sqrt(1 - (p.wavelength * eta / (2 * p.vr)) ** 2)
    z = p.c * p.r0 * eta**2 / (2 * p.vr**2 * p.fc**3 * d**3)
    km = p.kr / (1 - p.kr * z)
    x = x * np.exp(1j * np.pi * km * (1 / d - 1) * (tau - 2 * p.r0 / (p.c * d)) ** 2)
    x = forward(x, 1) * np.exp(1j * np.pi * d / km * f**2) * np.exp(4j * np.pi / p.c * p.r0 * (1 / d - 1) * f) * win_r
    x = back(x, 1) * np.exp(2j * np.pi * p.fc * tau * (d - 1))
    return np.abs(back(x * win_a[:, None], 0))


@pytest.mark.parametrize("chain", imaging.CHAINS)
def test_chains_on_one_array(spark, chain):
    n = 64
    p = synthetic_params(n)
    raw = stripmap_echo(spark, n, p, demo_scene(n, p)).cache()
    want = whole_scene(chain, L.to_numpy(raw), n, p)
    got = L.to_numpy(imaging.CHAINS[chain](raw, n, p)).real
    np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-6 * want.max())


@pytest.mark.parametrize("chain", imaging.CHAINS)
def test_quality(spark, chain):
    n = 256
    p = synthetic_params(n)
    found = metrics.measure_image(imaging.CHAINS[chain](stripmap_echo(spark, n, p, [(0.0, 0.0, 1.0)]), n, p).cache())
    loose = chain == "range_doppler"
    cut = found["range"]
    assert cut["irw"] < 2.25 and cut["pslr"] < (-33.5 if loose else -36) and cut["islr"] < (-19 if loose else -22)
    assert found["azimuth"]["irw"] < 2.25 and found["azimuth"]["pslr"] < -36


def test_scene_pixels(spark):
    n = 128
    p = synthetic_params(n)
    image = np.abs(L.to_numpy(imaging.omega_k(stripmap_echo(spark, n, p, demo_scene(n, p)), n, p)))
    for target in demo_scene(n, p):
        r, c = (round(x) for x in target_pixel(n, p, target))
        near = image[r - 2 : r + 3, c - 2 : c + 3]
        assert near.max() > 0.5 * image.max()


def test_polar_format(spark):
    g = Geometry(64)
    image = np.abs(L.to_numpy(imaging.polar_format(g.echo(spark, g.demo_targets()), g)))
    assert image.shape == (128, 128)
    for x, y in g.demo_targets():
        r, c = 64 + round(2 * y), 64 + round(2 * x)
        assert image[r - 1 : r + 2, c - 1 : c + 2].max() > 0.5 * image.max()
    one = Geometry(64)
    smooth, plain = (metrics.measure_cut(np.abs(L.to_numpy(imaging.polar_format(one.echo(spark, [(0.0, 0.0)]), one, a)))[64], 8) for a in (True, False))
    assert smooth["pslr"] < -18 and plain["pslr"] > -15.5


def test_sva_is_a_clamp():
    x = np.array([[1.0, 2.0, 4.0, 2.0, 1.0, -1.0, 0.0]])
    assert imaging.sva(x)[0].tolist() == [1.0, 2.0, 4.0, 2.0, 1.0, -1.0, 0.0]
    assert imaging.sva(np.array([[1.0, 0.0, -1.0, 0.0, 1.0]]))[0, 2] == 0.0


def test_parameters():
    assert alos_params(16384).t_shift == 4800 / 32e6 and alos_params(64).t_shift == 32 / 32e6


def test_ceos(spark, tmp_path):
    leader = bytearray(720 + 4096)
    leader[720 + 8 : 720 + 12] = struct.pack(">I", 4096)
    for at, value in ((501, "0.2360571"), (711, "32.0"), (935, "2155172.0")):
        leader[720 + at - 1 : 720 + at - 1 + 16] = value.rjust(16).encode()
    head = bytearray(720 + 412)
    head[720 + 116 : 720 + 118] = struct.pack(">H", 12)
    head[720 + 120 : 720 + 124] = struct.pack(">I", 100)
    found = ceos.parse_leader(bytes(leader), bytes(head))
    assert found["fs"] == 32e6 and found["prf"] == 2155.172 and abs(found["fc"] - 299792458 / 0.2360571) < 1
    assert abs(found["r0"] - 299792458 / 2 * (12 / 2155.172 + 1e-7 - 3.07e-5)) < 1e-6
    raw = np.random.default_rng(0).integers(0, 32, (4, 12), dtype=np.uint8)
    path = tmp_path / "image"
    path.write_bytes(bytes(720) + b"".join(bytes(412) + line.tobytes() for line in raw))
    got = L.to_numpy(ceos.read_ceos_raw(spark, f"file://{path}", 3, 6, start=1, width=8))
    want = raw[1:, 0::2] - raw[1:, 0::2].mean() + 1j * (raw[1:, 1::2] - raw[1:, 1::2].mean())
    np.testing.assert_allclose(got, np.pad(want, ((0, 0), (0, 2))), atol=1e-12)


def test_flat(spark, tmp_path):
    data = np.arange(12, dtype="c8").reshape(3, 4)
    path = tmp_path / "flat"
    path.write_bytes(data.tobytes())
    np.testing.assert_allclose(L.to_numpy(ceos.read_flat(spark, f"file://{path}", 3, 4)), data)
    with pytest.raises(LaunchError):
        ceos.read_flat(spark, f"file://{path}", 4, 4)


def test_scene_metrics(spark):
    rng = np.random.default_rng(4)
    image = rng.random((16, 16)) + np.pad(np.ones((8, 8)), ((0, 8), (8, 0))) * 5
    i, j = np.indices(image.shape)
    cells = spark.createDataFrame(list(zip(i.ravel().tolist(), j.ravel().tolist(), image.ravel().tolist())), "i long, j long, v double")
    for n in (16, 15, 14):  # the last with looks and tiles cut by the edges
        part = cells.where(f"i < {n} and j < {n}")
        looked = image[: n - n % 2, : n - n % 2].reshape(n // 2, 2, n // 2, 2).mean((1, 3))
        tiles = [looked[a : a + 2, b : b + 2] for a in range(0, n // 2 - 1, 2) for b in range(0, n // 2 - 1, 2)]
        best = max(tiles, key=np.sum)
        assert metrics.scene_contrast(part, 4, 2).first()[0] == pytest.approx(best.std() / best.mean())
    assert metrics.scene_contrast(cells, 32, 2).first()[0] is None
    with pytest.raises(TraceError):
        metrics.scene_contrast(cells, 5, 2)
    db = metrics.db_image(cells).agg(F.max("db"), F.min("db")).first()
    assert db[0] == pytest.approx(0, abs=1e-9) and db[1] >= -60
    flat = metrics.stretched(cells).agg(F.min("v"), F.max("v")).first()
    assert tuple(flat) == (0.0, 1.0)


def test_streamed_pulses(spark, tmp_path):
    n = 64
    p = synthetic_params(n)
    echo = stripmap_echo(spark, n, p, [(0.0, 0.0, 1.0)])
    echo.write.parquet(str(tmp_path / "in"))
    stream = range_compress(spark.readStream.schema(echo.schema).parquet(str(tmp_path / "in")), n, p)
    stream.writeStream.format("memory").queryName("pulses").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    np.testing.assert_allclose(L.to_numpy(spark.table("pulses")), L.to_numpy(range_compress(echo, n, p)), atol=1e-9)
