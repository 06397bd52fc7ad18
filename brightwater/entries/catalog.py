"""Importing this module registers every query."""

from brightwater.entries import (  # noqa: F401
    chunks,
    churn,
    guard_jobs,
    ops_tables,
    request_log,
    retrieval,
    stores_streams,
)
