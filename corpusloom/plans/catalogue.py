"""Every query of the engine by name, and its SQL for a second engine."""

from __future__ import annotations

from . import documents, relational, served, streams

QUERIES = relational.QUERIES | documents.QUERIES | streams.QUERIES | served.QUERIES
ORACLES = relational.ORACLES | documents.ORACLES | streams.ORACLES | served.ORACLES
