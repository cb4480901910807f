"""Every registered query of the engine's own operators, and its SQL."""

from __future__ import annotations

from quire.plans import oracles, queries

QUERIES = {k[2:]: f for k, f in vars(queries).items() if k.startswith("q_")}
ORACLES = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
