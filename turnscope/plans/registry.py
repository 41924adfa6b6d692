"""Every registered query of the engine with its DuckDB equivalent."""

from __future__ import annotations

from . import q_claims, q_decisions, q_extra, q_extract, q_grounding, q_language, q_maintext, q_scale, q_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (q_extract, q_decisions, q_grounding, q_claims, q_extra, q_scale, q_language, q_stream, q_maintext):
    QUERIES |= _m.Q
    ORACLES |= _m.S
