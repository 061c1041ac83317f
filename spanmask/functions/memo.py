"""Reuse built Column trees within one Spark context.

Building a large expression from Python costs one gateway call per node; the
scan's expressions have thousands of nodes.  Columns reference columns by
name only, so the same tree can be reused by every DataFrame of the session.
"""
from __future__ import annotations

from typing import Callable, Hashable

from pyspark import SparkContext

_CACHE: dict = {}


def memo_columns(key: Hashable, build: Callable[[], object]):
    sc = SparkContext._active_spark_context
    k = (sc.applicationId, key)
    if k not in _CACHE:
        _CACHE[k] = build()
    return _CACHE[k]
