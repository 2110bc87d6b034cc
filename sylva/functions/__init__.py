"""Scalar expressions."""

from .binning import down_rez, dyadic
from .hashing import hash32, uniform

__all__ = ["down_rez", "dyadic", "hash32", "uniform"]
