"""All queries of the engine's own operators, by family."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("q_ingest", "q_search", "q_text", "q_retrieval", "q_memory", "q_code", "q_chunks", "q_streaming", "q_more", "q_wider", "q_oracles", "q_overview"):
    try:
        _m = importlib.import_module(f".{_name}", __package__)
    except ModuleNotFoundError as _e:
        if not (_e.name or "").endswith(_name):
            raise
        continue
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
