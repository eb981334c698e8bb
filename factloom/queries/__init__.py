from . import arrays, filings, ledger, profiles, rows, sequences, sources, streams, texts, vectors  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
