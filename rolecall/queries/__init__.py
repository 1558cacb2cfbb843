"""Every operator as a named query over the test tables."""

from . import details, filtering, merging, profiles, ranking, texts  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
