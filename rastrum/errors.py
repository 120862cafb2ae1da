"""Errors and warnings."""


class RasterError(Exception):
    """Base of all errors of this package."""


class TraceError(RasterError, TypeError):
    """An expression that is refused before any job runs."""


class LaunchError(RasterError):
    """Data that doesn't fit its declared shape or type."""


class DomainWarning(UserWarning):
    """Time and spectral domains, or centred and plain axes, are mixed."""


class PrecisionWarning(UserWarning):
    """A double-precision constant widens a single-precision raster."""
