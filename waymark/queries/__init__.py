"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import answering, binding, catalog, checks, evaluation, flow, ingest, ports, whole

QUERIES = {name: f for m in (catalog, binding, flow, ingest, evaluation, checks, whole, answering, ports) for name, (f, _) in m.ALL.items()}
ORACLES = {name: sql for m in (catalog, binding, flow, ingest, evaluation, checks, whole, answering, ports) for name, (_, sql) in m.ALL.items() if sql}
