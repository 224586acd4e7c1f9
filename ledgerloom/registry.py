"""The named queries over the driver's tables and their DuckDB oracles."""

from __future__ import annotations

from ledgerloom.plans import assembly_queries, evidence_queries, file_queries, graph_queries, ledger_queries, mechanism_queries, report_queries, rule_queries

QUERIES = {**ledger_queries.QUERIES, **graph_queries.QUERIES, **rule_queries.QUERIES, **evidence_queries.QUERIES, **mechanism_queries.QUERIES, **assembly_queries.QUERIES, **file_queries.QUERIES, **report_queries.QUERIES}
ORACLES = {**ledger_queries.ORACLES, **graph_queries.ORACLES, **rule_queries.ORACLES, **evidence_queries.ORACLES, **mechanism_queries.ORACLES, **assembly_queries.ORACLES, **file_queries.ORACLES, **report_queries.ORACLES}
