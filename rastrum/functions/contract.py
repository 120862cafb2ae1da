"""Signatures of functions over rasters."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

from rastrum.errors import LaunchError, TraceError
from rastrum.raster import Raster
from rastrum.types import TensorSpec


def _held(name: str, value, spec: TensorSpec) -> Raster:
    if isinstance(value, np.ndarray):
        value = Raster.from_numpy(SparkSession.active(), value)
    if not isinstance(value, Raster):
        raise LaunchError(f"{name}: {type(value).__name__} instead of {spec}")
    if value.spec != spec:
        raise LaunchError(f"{name}: {value.spec} instead of {spec}")
    return value


def func(f: Callable) -> Callable:
    """Check a function's rasters against its annotations, ``x: c64[512, 512]``, before any job.

    Arrays become rasters.  All parameters are annotated or none is; without annotations
    a call takes any rasters.  The result is the lazy plan that the function returns,
    checked against its annotation if it has one."""
    signature = inspect.signature(f, eval_str=True)
    specs = {p.name: p.annotation for p in signature.parameters.values() if p.annotation is not p.empty}
    if specs and len(specs) < len(signature.parameters):
        raise TraceError(f"{f.__name__}: some parameters have no annotation")
    for name, spec in specs.items():
        if not isinstance(spec, TensorSpec):
            raise TraceError(f"{f.__name__}: {name} is annotated {spec!r}")
    returned = signature.return_annotation

    @functools.wraps(f)
    def call(*args, **kwargs):
        try:
            bound = signature.bind(*args, **kwargs)
        except TypeError as e:
            raise TraceError(f"{f.__name__}: {e}") from None
        for name, spec in specs.items():
            if name in bound.arguments:
                bound.arguments[name] = _held(f"{f.__name__}, {name}", bound.arguments[name], spec)
        out = f(*bound.args, **bound.kwargs)
        return _held(f"{f.__name__}, result", out, returned) if isinstance(returned, TensorSpec) else out

    return call
