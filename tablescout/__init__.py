"""Spark-native table discovery over a data lake."""

from tablescout.engine import TableScout

__all__ = ["TableScout"]
