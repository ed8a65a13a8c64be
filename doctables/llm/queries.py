"""All queries of this subpackage."""

from __future__ import annotations

from . import caps, filter_audit, html_main, langid, lm, minhash, mixing, outliers, packing, quality, resampling, tokens, warc  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
