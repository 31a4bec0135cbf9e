"""Times as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    """Milliseconds since 1970, rounded to the nearest and halves away from zero, as ``epoch_ms`` of DuckDB; Spark's own ``unix_millis`` cuts."""
    at = ts.cast("timestamp")
    half = F.when(F.unix_micros(at) < 0, 501).otherwise(500)
    return F.unix_millis(at) + F.when(F.pmod(F.unix_micros(at), F.lit(1000)) >= half, 1).otherwise(0)
