"""Queries over the driver's tables, and the same in SQL.

The raster A is ``embeddings``: line vec_id, 64 samples.  B is A with its lines
reversed, Z = A + jB.  Values are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum import raster as R
from rastrum import types as T
from rastrum.functions import windows
from rastrum.plans import imaging, metrics
from rastrum.sources.params import synthetic_params
from rastrum.sources.simulate import Geometry, demo_scene, stripmap_echo

N = 64


def raster_a(spark: SparkSession, sf_dir: str) -> R.Raster:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0] + 1
    return R.Raster.from_cells(table, T.f64[n, N])


def raster_z(spark: SparkSession, sf_dir: str) -> R.Raster:
    """Both parts from one scan, so that they stay columns of one frame."""
    a = raster_a(spark, sf_dir)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.posexplode(F.arrays_zip(F.col("embedding").alias("re"), F.reverse("embedding").alias("im"))).alias("j", "x"))
    return R.Raster.from_cells(table.select("i", "j", "x.re", "x.im"), T.c128[a.shape])


_A = f"with a as (select vec_id::bigint as i, (unnest(range(0, {N})))::bigint as j, (unnest(embedding))::double as v from embeddings)"
_Z = _A + f", z as (select a.i, a.j, a.v as re, b.v as im from a join a b on a.i = b.i and b.j = {N - 1} - a.j)"


def _shown(x: R.Raster) -> DataFrame:
    cells = x.cells()
    if x.rank == 1:
        cells = cells.drop("i")
    if x.dtype.kind == "i":
        return cells
    return cells.select(*(c for c in cells.columns if c in ("i", "j")), *((F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in cells.columns if c not in ("i", "j")))


def _r(e: str) -> str:
    return f"round({e}, 6) + 0.0"


_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _of_a(name: str, f: Callable[[R.Raster], R.Raster], sql: str) -> None:
    _QUERIES[name] = (lambda spark, sf: _shown(f(raster_a(spark, sf))), f"{_A} {sql}")


def _of_z(name: str, f: Callable[[R.Raster], R.Raster], sql: str) -> None:
    _QUERIES[name] = (lambda spark, sf: _shown(f(raster_z(spark, sf))), f"{_Z} {sql}")


def _each(name: str, f, e: str) -> None:
    _of_a(name, f, f"select i, j, {_r(e)} as v from a")


def _each_z(name: str, f, re: str, im: str | None = None) -> None:
    _of_z(name, f, f"select i, j, {_r(re)} as {'re' if im else 'v'}{f', {_r(im)} as im' if im else ''} from z")


# element-wise
_each("add", lambda a: a + a, "v + v")
_each("add_scalar", lambda a: a + 1.5, "v + 1.5")
_each("sub", lambda a: 1.0 - a, "1.0 - v")
_each("mul", lambda a: a * a, "v * v")
_each("mul_scalar", lambda a: a * 3.0, "v * 3.0")
_each("div", lambda a: a / (a * a + 1.0), "v / (v * v + 1.0)")
_each("neg", lambda a: -a, "-v")
_each("pow", lambda a: a**3, "v * v * v")
_each("sqrt", lambda a: R.sqrt(a * a), "sqrt(v * v)")
_each("cos", R.cos, "cos(v)")
_each("sin", R.sin, "sin(v)")
_each("exp", R.exp, "exp(v)")
_each("log", lambda a: R.log(R.abs_(a) + 1.0), "ln(abs(v) + 1.0)")
_each("log2", lambda a: R.log2(R.abs_(a) + 1.0), "ln(abs(v) + 1.0) / ln(2)")
_each("log10", lambda a: R.log10(R.abs_(a) + 1.0), "ln(abs(v) + 1.0) / ln(10)")
_each("atan2", lambda a: R.atan2(a, a * a + 0.5), "atan2(v, v * v + 0.5)")
_each("abs", R.abs_, "abs(v)")
_each("sign", R.sign, "case when v > 0 then 1.0 when v < 0 then -1.0 else 0.0 end")
_each("floor", lambda a: R.floor(a * 10.0), "floor(v * 10.0)")
_each("ceil", lambda a: R.ceil(a * 10.0), "ceil(v * 10.0)")
_each("round", lambda a: R.round_(a * 10.0), "round(v * 10.0)")
_each("clip", lambda a: R.clip(a, -0.05, 0.05), "least(greatest(v, -0.05), 0.05)")
_each("maximum", lambda a: R.maximum(a, 0.02), "greatest(v, 0.02)")
_each("minimum", lambda a: R.minimum(a, 0.02), "least(v, 0.02)")
_each("compare", lambda a: a > 0.01, "case when v > 0.01 then 1.0 else 0.0 end")
for _name, _f, _e in (("lt", lambda a: a < 0.01, "<"), ("le", lambda a: a <= 0.01, "<="), ("ge", lambda a: a >= 0.01, ">=")):
    _each(f"compare_{_name}", _f, f"case when v {_e} 0.01 then 1.0 else 0.0 end")
_each("compare_eq", lambda a: R.sign(a) == 1.0, "case when v > 0 then 1.0 else 0.0 end")
_each("compare_ne", lambda a: R.sign(a) != 1.0, "case when v > 0 then 0.0 else 1.0 end")
_each("where", lambda a: R.where(a < 0.0, a * 2.0, 1.0), "case when v < 0 then v * 2.0 else 1.0 end")
_each("mag2db", lambda a: R.mag2db(R.abs_(a) + 1.0), "20 * ln(abs(v) + 1.0) / ln(10)")
_each("pow2db", lambda a: R.pow2db(R.abs_(a) + 1.0), "10 * ln(abs(v) + 1.0) / ln(10)")
_each("db2mag", R.db2mag, "exp(v * ln(10) / 20)")
_each("db2pow", R.db2pow, "exp(v * ln(10) / 10)")
_each("sinc", R.sinc, "case when v = 0 then 1.0 else sin(pi() * v) / (pi() * v) end")
_each("hypot", lambda a: R.hypot(a, a + 1.0), "sqrt(v * v + (v + 1.0) * (v + 1.0))")
_of_a("cast", lambda a: R.cast(a * 100.0, T.i64), "select i, j, trunc(v * 100.0)::bigint as v from a")
_each_z("complex_mul", lambda z: z * z, "re * re - im * im", "2 * re * im")
_each_z("complex_div", lambda z: z / (R.conj(z) + 2.0), "(re * (re + 2) + im * -im) / ((re + 2) * (re + 2) + im * im)", "(im * (re + 2) - re * -im) / ((re + 2) * (re + 2) + im * im)")
_each_z("conj", R.conj, "re", "-im")
_each_z("real", R.real, "re")
_each_z("imag", R.imag, "im")
_each_z("angle", R.angle, "atan2(im, re)")
_each_z("complex_abs", R.abs_, "sqrt(re * re + im * im)")
_each_z("make_complex", lambda z: R.make_complex(R.imag(z), R.real(z)), "im", "re")
_each_z("expj", lambda z: R.expj(R.real(z)), "cos(re)", "sin(re)")
_each_z("dechirp", lambda z: R.dechirp(z, z), "re * re + im * im", "im * re - re * im")
# reductions
for _dim, _stay in ((0, "j"), (1, "i")):
    for _name, _f, _e in (("sum", R.sum_, "sum(v)"), ("max", R.max_, "max(v)"), ("min", R.min_, "min(v)"), ("mean", R.mean, "avg(v)"), ("var", R.var, "var_pop(v)"), ("std", R.std, "stddev_pop(v)")):
        _of_a(f"{_name}_axis{_dim}", lambda a, f=_f, d=_dim: f(a, d), f"select {_stay} as j, {_r(_e)} as v from a group by 1")
    _other = "i" if _stay == "j" else "j"
    _of_a(f"argmax_axis{_dim}", lambda a, d=_dim: R.argmax(a, d), f"select j, v from (select {_stay} as j, {_other} as v, row_number() over (partition by {_stay} order by a.v desc, {_other}) as n from a) where n = 1")
    _of_a(f"argmin_axis{_dim}", lambda a, d=_dim: R.argmin(a, d), f"select j, v from (select {_stay} as j, {_other} as v, row_number() over (partition by {_stay} order by a.v, {_other}) as n from a) where n = 1")
    _of_a(f"cumsum_axis{_dim}", lambda a, d=_dim: R.cumsum(a, d), f"select i, j, {_r(f'sum(v) over (partition by {_stay} order by {_other} rows unbounded preceding)')} as v from a")
    _of_a(f"flip_axis{_dim}", lambda a, d=_dim: R.flip(a, d), f"select {'(select max(i) from a) - i as i, j' if _dim == 0 else f'i, {N - 1} - j as j'}, {_r('v')} as v from a")
_of_a("sum_all", lambda a: R.sum_(a), f"select 0::bigint as j, {_r('sum(v)')} as v from a")
_of_z("complex_sum_axis0", lambda z: R.sum_(z, 0), f"select j, {_r('sum(re)')} as re, {_r('sum(im)')} as im from z group by 1")
_of_z("complex_cumsum_axis1", lambda z: R.cumsum(z, 1), "select i, j, {} as re, {} as im from z".format(*(_r(f"sum({p}) over (partition by i order by j rows unbounded preceding)") for p in ("re", "im"))))
_of_a("rank_filter", lambda a: R.rank_filter(a, 3, 0), f"select x.i, x.j, {_r('min(y.v)')} as v from a x, unnest([-1, 0, 1]) as t(k), a y where y.i = x.i and y.j = least(greatest(x.j + t.k, 0), {N - 1}) group by 1, 2")
_QUERIES["scene_contrast"] = (
    lambda spark, sf: metrics.scene_contrast(R.abs_(raster_a(spark, sf)).cells(), 16, 4).select(F.round("contrast", 6).alias("contrast")),
    f"{_A}, m as (select i // 4 as i, j // 4 as j, avg(abs(v)) as v from a group by 1, 2 having count(*) = 16),"
    " t as (select i // 4 as a, j // 4 as b, sum(v) as total, stddev_pop(v) / avg(v) as contrast from m group by 1, 2 having count(*) = 16)"
    f" select {_r('contrast')} as contrast from t order by total desc, a, b limit 1",
)
_of_a("multilook", lambda a: R.multilook(a, (4, 8), partial=True), f"select i // 4 as i, j // 8 as j, {_r('avg(v)')} as v from a group by 1, 2")
_of_a("sort", R.sort, f"select i, row_number() over (partition by i order by v, j) - 1 as j, {_r('v')} as v from a")
_of_a("median_filter", lambda a: R.median_filter(a, 5), f"select x.i, x.j, {_r('list_sort(list(y.v))[3]')} as v from a x, unnest([-2, -1, 0, 1, 2]) as t(k), a y where y.i = x.i and y.j = least(greatest(x.j + t.k, 0), {N - 1}) group by 1, 2")
# layout
_of_a("transpose", R.transpose, f"select j as i, i as j, {_r('v')} as v from a")
_of_a("slice", lambda a: a[2:50:3, -16:], f"select (i - 2) // 3 as i, j - 48 as j, {_r('v')} as v from a where i >= 2 and i < 50 and (i - 2) % 3 = 0 and j >= 48")
_of_a("dynamic_slice", lambda a: R.dynamic_slice(a, (5, 60), (7, 8)), f"select i - 5 as i, j - 56 as j, {_r('v')} as v from a where i between 5 and 11 and j >= 56")
_of_a("dynamic_update_slice", lambda a: R.dynamic_update_slice(a, a[0:3, 0:4], (1, 2)), f"select a.i, a.j, {_r('coalesce(b.v, a.v)')} as v from a left join a b on b.i = a.i - 1 and b.j = a.j - 2 and b.i < 3 and b.j < 4")
_of_a("concatenate", lambda a: R.concatenate([a, a * 2.0], 1), f"select i, j, {_r('v')} as v from a union all select i, j + {N}, {_r('v * 2.0')} from a")
_of_a("pad", lambda a: R.pad(a, ((0, 0), (1, 2)), 9.0), f"select i, j + 1 as j, {_r('v')} as v from a union all select i, x, 9.0 from (select distinct i from a), unnest([0, {N + 1}, {N + 2}]) as t(x)")
_of_a("fftshift", lambda a: R.fftshift(a, 1), f"select i, (j + {N // 2}) % {N} as j, {_r('v')} as v from a")
_of_a("ifftshift", lambda a: R.ifftshift(a, 1), f"select i, (j + {N // 2}) % {N} as j, {_r('v')} as v from a")
_of_a("circshift", lambda a: R.circshift(a, -5, 1), f"select i, (j + {N - 5}) % {N} as j, {_r('v')} as v from a")
_of_a("vector_join", lambda a: a * R.Raster.from_numpy(a.frame.sparkSession, windows.hanning(N)), f"select i, j, {_r(f'v * (0.5 - 0.5 * cos(2 * pi() * j / {N - 1}))')} as v from a")
_of_a("broadcast", lambda a: R.broadcast(R.mean(a, 1), 3, 1), f"select i, k as j, {_r('m')} as v from (select i, avg(v) as m from a group by 1), range(0, 3) as t(k)")
_of_a("iterate", lambda a: R.iterate(3, lambda x: x * 0.5 + 1.0, a), f"select i, j, {_r('v * 0.125 + 1.75')} as v from a")
# signals
_DFT = "select z.i, k as j, {} as re, {} as im from z, range(0, 64) as t(k) group by 1, 2"
_ANGLE = "(2 * pi() * ((z.j * k) % 64) / 64)"
_FORWARD = (f"sum(re * cos({_ANGLE}) + im * sin({_ANGLE}))", f"sum(im * cos({_ANGLE}) - re * sin({_ANGLE}))")
_INVERSE = (f"sum(re * cos({_ANGLE}) - im * sin({_ANGLE})) / 64", f"sum(im * cos({_ANGLE}) + re * sin({_ANGLE})) / 64")
_of_z("fft", lambda z: R.fft(z, 1), _DFT.format(*map(_r, _FORWARD)))
_of_z("ifft", lambda z: R.ifft(R.Raster(z.frame, z.re, z.im, z.spec, ((False, False), (True, False))), 1), _DFT.format(*map(_r, _INVERSE)))
_of_z("matched_filter", lambda z: R.matched_filter(z, np.eye(1, 8, 3)[0]), f"select i, (j + {N - 3}) % {N} as j, {_r('re')} as re, {_r('im')} as im from z")
_of_z(
    "interp1d_linear",
    lambda z: R.interp1d(z, R.Raster(z.frame, F.col("j") + F.lit(0.25), None, T.f64[z.shape]), kernel="linear"),
    f"select a.i, a.j, {_r('0.75 * a.re + 0.25 * coalesce(b.re, 0)')} as re, {_r('0.75 * a.im + 0.25 * coalesce(b.im, 0)')} as im from z a left join z b on b.i = a.i and b.j = a.j + 1",
)
_of_z(
    "gather2d",
    lambda z: R.gather2d(z, *(R.Raster(z.frame, F.col(c) + F.lit(d), None, T.f64[z.shape]) for c, d in (("i", 0.5), ("j", -0.25))), boundary="edge"),
    "select a.i, a.j, {} as re, {} as im from z a join z b on b.i = a.i and b.j = greatest(a.j - 1, 0) join z c on c.i = least(a.i + 1, (select max(i) from a)) and c.j = a.j join z d on d.i = c.i and d.j = b.j".format(
        *(_r(f"0.5 * (0.75 * a.{p} + 0.25 * b.{p}) + 0.5 * (0.75 * c.{p} + 0.25 * d.{p})") for p in ("re", "im"))
    ),
)
_of_z(
    "fft2",
    lambda z: R.fft2(z[:16, :16]),
    "select u as i, k as j, {} as re, {} as im from (select * from z where i < 16 and j < 16) z, range(0, 16) as t(k), range(0, 16) as s(u) group by 1, 2".format(
        *(_r(e.replace("#", "(2 * pi() * ((z.j * k + z.i * u) % 16) / 16)")) for e in ("sum(re * cos(#) + im * sin(#))", "sum(im * cos(#) - re * sin(#))"))
    ),
)
_of_z("fft_ortho", lambda z: R.fft(z, 1, "ortho"), _DFT.format(*(_r(f"({e}) / 8") for e in _FORWARD)))
_of_z("fft_forward", lambda z: R.fft(z, 1, "forward"), _DFT.format(*(_r(f"({e}) / 64") for e in _FORWARD)))
_of_z(
    "ifft2",
    lambda z: R.ifft2(R.Raster(z[:16, :16].frame, F.col("re"), F.col("im"), T.c128[16, 16], ((True, False), (True, False)))),
    "select u as i, k as j, {} as re, {} as im from (select * from z where i < 16 and j < 16) z, range(0, 16) as t(k), range(0, 16) as s(u) group by 1, 2".format(
        *(_r(e.replace("#", "(2 * pi() * ((z.j * k + z.i * u) % 16) / 16)")) for e in ("sum(re * cos(#) - im * sin(#)) / 256", "sum(im * cos(#) + re * sin(#)) / 256"))
    ),
)
# interpolation at j + 0.6: the taps k samples from j, and where the boundary finds them
_D = "(0.6 - k)"
_SINC = f"sin(pi() * {_D}) / (pi() * {_D})"
_I0 = "list_sum(list_transform(range(0, 30), lambda m: pow({} / 2, 2 * m) / pow(factorial(m::int)::double, 2)))"
_SHAPE = f"least(abs({_D}) / 4, 1.0)"
_KERNELS = {
    "nearest": ("1.0", (1, 2)),
    "linear": ("case when k = 0 then 0.4 else 0.6 end", (0, 2)),
    "cubic": (f"case when abs({_D}) < 1 then (1.5 * abs({_D}) - 2.5) * {_D} * {_D} + 1 else ((-0.5 * abs({_D}) + 2.5) * abs({_D}) - 4) * abs({_D}) + 2 end", (-1, 3)),
    "sinc_rect": (_SINC, (-3, 5)),
    "sinc_hann": (f"{_SINC} * (0.5 + 0.5 * cos(pi() * {_SHAPE}))", (-3, 5)),
    "sinc_hamming": (f"{_SINC} * (0.54 + 0.46 * cos(pi() * {_SHAPE}))", (-3, 5)),
    "sinc_kaiser": (f"{_SINC} * {_I0.format(f'(2.5 * sqrt(1 - {_SHAPE} * {_SHAPE}))')} / {_I0.format('2.5')}", (-3, 5)),
}
_FOUND = {"zero": "x.j + k", "edge": f"greatest(least(x.j + k, {N - 1}), 0)", "reflect": f"case when (x.j + k + {2 * N}) % {2 * N} < {N} then (x.j + k + {2 * N}) % {2 * N} else {2 * N - 1} - (x.j + k + {2 * N}) % {2 * N} end"}
for _name, _boundary in (("nearest", "edge"), ("linear", "reflect"), ("cubic", "zero"), ("cubic", "reflect"), ("sinc_rect", "edge"), ("sinc_hann", "zero"), ("sinc_hamming", "edge"), ("sinc_kaiser", "reflect")):
    _weight, _taps = _KERNELS[_name]
    _kind, _, _shape = _name.partition("_")
    _of_z(
        f"interp1d_{_name}_{_boundary}",
        lambda z, k=_kind, w=_shape or "hann", b=_boundary: R.interp1d(z, R.Raster(z.frame, F.col("j") + F.lit(0.6), None, T.f64[z.shape]), kernel=k, window=w, boundary=b),
        f"select x.i, x.j, {_r(f'sum(({_weight}) * y.re)')} as re, {_r(f'sum(({_weight}) * y.im)')} as im from z x, range({_taps[0]}, {_taps[1]}) as t(k), z y where y.i = x.i and y.j = {_FOUND[_boundary]} group by 1, 2",
    )
# the wavenumber grid: lines at Doppler frequencies -500 to 500 Hz, samples at range frequencies -1 to 1 MHz
_of_z(
    "stolt_interp",
    lambda z: R.stolt_interp(z, np.linspace(-500, 500, z.shape[0]), np.linspace(-1e6, 1e6, N), c=3e8, fc=1.27e9, vr=7100.0, t_shift=1.5e-6),
    f", f as (select *, -1e6 + 2e6 * j / {N - 1} as fr, -500 + 1000 * i / (select max(i) from a)::double as fa from z),"
    " s as (select i, j, fr, re * cos(2 * pi() * fr * 1.5e-6) - im * sin(2 * pi() * fr * 1.5e-6) as re, re * sin(2 * pi() * fr * 1.5e-6) + im * cos(2 * pi() * fr * 1.5e-6) as im,"
    f" (sqrt((fr + 1.27e9) * (fr + 1.27e9) + (3e8 * fa / 14200) * (3e8 * fa / 14200)) - 1.27e9 + 1e6) / (2e6 / {N - 1}) as p from f),"
    " t as (select i, j, fr, p, floor(p)::bigint + k as k, p - floor(p) - k as d from s, range(-3, 5) as t(k)),"
    " w as (select t.i, t.j, t.fr, sum(case when d = 0 then 1.0 else sin(pi() * d) / (pi() * d) end * (0.5 + 0.5 * cos(pi() * least(abs(d) / 4, 1.0))) * coalesce(s.re, 0)) as re,"
    " sum(case when d = 0 then 1.0 else sin(pi() * d) / (pi() * d) end * (0.5 + 0.5 * cos(pi() * least(abs(d) / 4, 1.0))) * coalesce(s.im, 0)) as im from t left join s on s.i = t.i and s.j = t.k group by 1, 2, 3)"
    f" select i, j, {_r('re * cos(2 * pi() * fr * 1.5e-6) + im * sin(2 * pi() * fr * 1.5e-6)')} as re, {_r('im * cos(2 * pi() * fr * 1.5e-6) - re * sin(2 * pi() * fr * 1.5e-6)')} as im from w",
)
# offsets that are read when the job runs
_of_a(
    "dynamic_slice_at_peak",
    lambda a: R.dynamic_slice(a, (R.argmax(R.mean(a, 1)), R.argmax(R.mean(a, 0))), (4, 8)),
    ", p as (select (select i from (select i, avg(v) as m from a group by 1) order by m desc, i limit 1) as r, (select j from (select j, avg(v) as m from a group by 1) order by m desc, j limit 1) as c),"
    f" o as (select least(r, (select max(i) from a) - 3) as r, least(c, {N - 8}) as c from p)"
    f" select i - r as i, j - c as j, {_r('v')} as v from a, o where i >= r and i < r + 4 and j >= c and j < c + 8",
)
_WINDOWS = {"rect": "1.0", "hanning": "0.5 - 0.5 * cos(x)", "hamming": "0.54 - 0.46 * cos(x)", "blackman": "0.42 - 0.5 * cos(x) + 0.08 * cos(2 * x)"}
for _name, _e in _WINDOWS.items():
    _QUERIES[f"window_{_name}"] = (
        lambda spark, sf, n=_name: _shown(R.Raster.from_numpy(spark, windows.window(n, N))),
        f"select j::bigint as j, {_r(_e)} as v from (select j, 2 * pi() * j / {N - 1} as x from range(0, {N}) as t(j))",
    )
# imaging chains of a simulated scene, without SQL
SCENE = 128


def _image(chain: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = synthetic_params(SCENE)
        return chain(stripmap_echo(spark, SCENE, p, demo_scene(SCENE, p)), SCENE, p).select("row", F.transform("re", lambda x: F.round(x, 6)).alias("image"))

    return run


for _name, _chain in imaging.CHAINS.items():
    _QUERIES[f"chain_{_name}"] = (_image(_chain), None)


def polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Geometry(SCENE // 2)
    return imaging.polar_format(g.echo(spark, g.demo_targets()), g).select("row", F.transform("re", lambda x: F.round(x, 6)).alias("image"))


_QUERIES["chain_polar_format"] = (polar, None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
