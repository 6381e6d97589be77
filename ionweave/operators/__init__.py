"""The registered operators."""

from . import background, consensus, cwt, dbscan, hot_pixel, moran, normalize, pick, prevalence, recalibrate, reference_ions, tolerance  # noqa: F401
from .base import Diagnostic, Operator, OpResult, names, operator, register  # noqa: F401
