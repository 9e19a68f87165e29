"""Requests to open streams, under a limit of open streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit(requests: DataFrame, name: str, position: str, most: int) -> DataFrame:
    """``requests`` with outcome: added, duplicate (open already), or limit once ``most`` streams are open, duplicates included.

    Positions are distinct. One name keeps its first request only, and of these the ``most`` first are enough to find where the limit begins, so
    nothing is ordered as a whole."""
    firsts = requests.groupBy(name).agg(F.min(position).alias("first"))
    full = firsts.orderBy("first").limit(most).agg(F.when(F.count("*") == most, F.coalesce(F.max("first"), F.lit(-(2**63)))).alias("full_at"))
    rows = requests.join(firsts, name).join(F.broadcast(full), F.lit(True))
    outcome = F.when(F.col(position) > F.col("full_at"), "limit").when(F.col(position) == F.col("first"), "added").otherwise("duplicate")
    return rows.withColumn("outcome", outcome).drop("first", "full_at")
