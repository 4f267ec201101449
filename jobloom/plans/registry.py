"""All queries over the supplied tables, by name, with their SQL."""

from __future__ import annotations

from . import journal_queries, queue_queries, stream_queries

QUERIES = {**queue_queries.QUERIES, **journal_queries.QUERIES, **stream_queries.QUERIES}
ORACLES = {**queue_queries.ORACLES, **journal_queries.ORACLES, **stream_queries.ORACLES}
