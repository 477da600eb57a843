"""All queries over the reference's operators, by name, and the DuckDB SQL of each."""

from __future__ import annotations

from quillmark.plans import datasets, kernels, layout, metadata, predictions, profiles, rollups, semantic, structure, summaries

_PARTS = (semantic, structure, rollups, datasets, kernels, layout, metadata, predictions, profiles, summaries)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL: dict[str, str] = {k: s for part in _PARTS for k, s in part.SQL.items()}
