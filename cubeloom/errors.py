"""Typed errors with the exit code of their family."""

from __future__ import annotations

import math
from typing import Any


class CubeError(Exception):
    """Message, hint and context; ``exit_code`` is what a command ends with."""

    exit_code = 1

    def __init__(self, message: str, *, hint: str | None = None, context: dict[str, Any] | None = None):
        super().__init__(message)
        self.message, self.hint, self.context = message, hint, dict(context or {})

    def __str__(self) -> str:
        return self.message + (f" ({self.hint})" if self.hint else "")

    def to_dict(self) -> dict[str, Any]:
        return {"error": type(self).__name__, "message": self.message, "hint": self.hint, "context": json_safe(self.context), "exit_code": self.exit_code}


def json_safe(value: Any) -> Any:
    """NaN and infinities, which JSON lacks, as null."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


class ConfigurationError(CubeError):
    """A request breaks a rule."""

    exit_code = 3


class ProductError(CubeError):
    """A product, or a path to one, is not what a request needs."""

    exit_code = 4


class RasterIOError(CubeError):
    """Reading or writing a raster failed."""

    exit_code = 5


class ProcessingError(CubeError):
    """An operator cannot give a result."""

    exit_code = 6


class PipelineError(CubeError):
    """A run of several stages failed."""

    exit_code = 7


class DependencyError(CubeError):
    """Something the engine needs is missing."""

    exit_code = 8


class UnsupportedError(CubeError):
    """A format, projection or option that this engine does not have."""

    exit_code = 9


class ProductStructureError(ProductError):
    """A product folder lacks a file, or has too many."""


class RasterMetadataError(ProductError):
    """A raster's header does not say what is needed."""


class MissingGeoreferencingError(ProductError):
    """A raster has no place on the ground."""


class MissingRPCMetadataError(ProductError):
    """A raster has no usable sensor model."""


class InvalidWavelengthError(ProductError):
    """No band has the wavelength that is asked for."""


class MissingDEMError(ProductError):
    """An elevation model is not there."""


class UnreadableDEMError(ProductError):
    """An elevation model cannot be used."""


class OutputPathError(ProductError):
    """An output folder cannot be written."""


class RasterReadError(RasterIOError):
    """A raster cannot be read."""


class RasterWriteError(RasterIOError):
    """A raster cannot be written."""


class MemoryBudgetExceededError(RasterIOError):
    """A read or an output is over its budget."""


class OrthorectificationError(ProcessingError):
    """Orthorectification gives nothing."""


class ReprojectionError(ProcessingError):
    """Reprojection gives nothing."""


class QualityMaskError(ProcessingError):
    """A quality mask cannot be made."""


class SpectralAnalysisError(ProcessingError):
    """An index or a profile cannot be made."""


class PreviewError(ProcessingError):
    """A preview cannot be made."""
