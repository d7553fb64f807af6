"""All registered queries of the note engine, with the SQL they are checked against."""

from __future__ import annotations

from notelake.plans import chat, index, literature, records, retrieval, text, vectors  # noqa: F401
from notelake.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
