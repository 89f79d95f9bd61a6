"""Registered queries over the driver tables, each with its SQL counterpart."""

import importlib

from catalogspark.plans.registry import ORACLES, QUERIES, expand

for _module in (
    "catalog_queries", "search_queries", "screen_queries", "alias_queries", "network_queries",
    "client_queries", "traffic_queries", "report_queries", "stream_queries",
):
    importlib.import_module(f"catalogspark.plans.{_module}")

__all__ = ["ORACLES", "QUERIES", "expand"]
