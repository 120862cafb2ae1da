"""Element types, promotion and shapes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rastrum.errors import TraceError


@dataclass(frozen=True)
class DType:
    name: str
    numpy: str
    spark: str  # of each part
    kind: str  # f, i or c
    wide: bool

    def __getitem__(self, shape) -> "TensorSpec":
        return TensorSpec(shape if isinstance(shape, tuple) else (shape,), self)

    def __repr__(self) -> str:
        return self.name


f32 = DType("f32", "float32", "float", "f", False)
f64 = DType("f64", "float64", "double", "f", True)
i32 = DType("i32", "int32", "int", "i", False)
i64 = DType("i64", "int64", "long", "i", True)
c64 = DType("c64", "complex64", "float", "c", False)
c128 = DType("c128", "complex128", "double", "c", True)
ALL = (f32, f64, i32, i64, c64, c128)


def of_numpy(dtype) -> DType:
    for d in ALL:
        if np.dtype(dtype) == np.dtype(d.numpy):
            return d
    raise TraceError(f"element type {dtype} isn't supported")


def promote(a: DType, b: DType) -> DType:
    """Integers only go with themselves; else the wider parts, complex if either is."""
    if a == b:
        return a
    if "i" in (a.kind, b.kind):
        raise TraceError(f"{a} and {b} don't go together; cast one of them")
    wide = a.wide or b.wide
    return (c128 if wide else c64) if "c" in (a.kind, b.kind) else (f64 if wide else f32)


def part(d: DType) -> DType:
    """The type of a complex type's parts."""
    return {"c64": f32, "c128": f64}.get(d.name, d)


def complex_of(d: DType) -> DType:
    return {"f32": c64, "f64": c128}.get(d.name, d)


@dataclass(frozen=True)
class TensorSpec:
    shape: tuple[int, ...]
    dtype: DType

    def __post_init__(self):
        if not 1 <= len(self.shape) <= 2:
            raise TraceError(f"rank {len(self.shape)} isn't supported")
        for n in self.shape:
            if isinstance(n, bool) or not isinstance(n, (int, np.integer)) or n < 1:
                raise TraceError(f"{n!r} isn't an extent")


def aligned(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """The shape of two operands together; rank 1 goes along the last axis of rank 2."""
    if a == b:
        return a
    if len(a) != len(b) and a[-1] == b[-1]:
        return a if len(a) == 2 else b
    raise TraceError(f"shapes {a} and {b} don't go together")
