"""Who may read what, as role-dependent views; and the one change that a client may make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

PUBLIC, SIGNED_IN = V.PUBLIC, V.SIGNED_IN


def readable(role: str) -> list[str]:
    return {"anon": PUBLIC, "authenticated": PUBLIC + SIGNED_IN, "service": PUBLIC + SIGNED_IN}.get(role, [])


def view(tables: dict[str, DataFrame], role: str) -> dict[str, DataFrame]:
    """The tables of the role; others are not there to be read."""
    return {name: df for name, df in tables.items() if name in readable(role)}


def acknowledge(alerts: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Open alerts (pending, triggered) whose id is among `ids` become acknowledged; others stay as they are."""
    asked = ids.select("id").where("id is not null").distinct().withColumn("_asked", F.lit(True))
    may = F.coalesce("_asked", F.lit(False)) & F.col("status").isin("pending", "triggered")
    marked = alerts.join(asked, "id", "left")
    return marked.withColumns({"acknowledged_at": F.when(may, as_of).otherwise(F.col("acknowledged_at")), "status": F.when(may, "acknowledged").otherwise(F.col("status"))}).drop("_asked")
