"""Scalar parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_number(text: Column) -> Column:
    """``1.5M``, ``10.2K``, ``1,234`` as doubles; NULL for anything else."""
    t = F.upper(F.trim(F.regexp_replace(text, ",", "")))
    scale = F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6).when(t.endswith("B"), 1e9).otherwise(1.0)
    return F.when(t.rlike(r"^[+-]?\d*\.?\d+[KMB]?$"), F.regexp_replace(t, "[KMB]$", "").try_cast("double") * scale)
