"""The queries of the driver contract, with equivalent SQL for DuckDB."""

from quillflow.catalog.oracle import ORACLE_SQL
from quillflow.catalog.queries import QUERIES
from quillflow.catalog.runs import URIS  # the import registers its queries

__all__ = ["ORACLE_SQL", "QUERIES", "URIS"]
