"""The registered queries of the library, with their SQL."""

from . import correction_queries, import_queries, ingest_queries, store_queries  # noqa: F401  they register their queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
