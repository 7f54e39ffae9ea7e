"""All registered queries: importing this module loads every module of queries."""

from tidemark.plans import accounting, alerts, audits, detection, discovery, evolution, hypotheses, joins, lifecycle, market, momentum, prediction, records, registries, reports, resampling, robustness, scenes, shapes, snapshots, streams, windows
from tidemark.plans.registry import ORACLE_SQL, QUERIES

MODULES = (market, windows, joins, accounting, alerts, discovery, detection, lifecycle, hypotheses, momentum, audits, prediction, evolution, records, registries, reports, resampling, robustness, scenes, shapes, snapshots, streams)
__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
