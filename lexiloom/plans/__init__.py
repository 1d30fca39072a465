"""The library's own queries over the test tables, with DuckDB SQL for each."""

from .queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
