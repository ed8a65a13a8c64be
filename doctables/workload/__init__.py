"""Queries over the shared test tables, one or more per operator."""

from . import answers, catalog, cleaning, documents, exports, indexed, ordered, profiling, rows, sources, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
