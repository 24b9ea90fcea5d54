"""Every query of the library with its DuckDB equivalent, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("s1_snapshots", "s2_news", "s3_authors", "s4_dashboard", "s5_channels", "s7_texts", "s14_sources", "s15_more", "s16_services")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "s1_topic_table"

for _name in MODULES:
    _module = import_module(f"galley.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
