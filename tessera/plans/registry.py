"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from tessera.plans import codestream_queries, delivery_queries, format_queries, layout_queries, plane_queries, sample_queries, stream_queries, structure_queries, wavelet_queries, window_queries

_MODULES = (window_queries, delivery_queries, stream_queries, sample_queries, format_queries, plane_queries, layout_queries, structure_queries, codestream_queries, wavelet_queries)

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
