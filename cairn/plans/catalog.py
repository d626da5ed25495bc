"""All registered queries."""

from __future__ import annotations

from . import analytics, dedup, files, integrity, jobs, parsers, repository, retention, streams  # noqa: F401  they register themselves
from .registry import ORACLE, QUERIES  # noqa: F401


def FLAGSHIP(spark, sf_dir):
    return QUERIES["prune_plan"](spark, sf_dir)
