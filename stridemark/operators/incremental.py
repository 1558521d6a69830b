"""Quotas and rates as batch operators; ``stridemark.streaming`` has their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quota(rows: DataFrame, session: str, order: str, value: str, most: int = 30) -> DataFrame:
    """Rows with ``allowed``: a session may ask for so many different values; repeats are free.

    What counts is in how many distinct values' first requests come up to this one's, so that only the distinct values
    of a session are ranked.
    """
    firsts = rows.groupBy(session, value).agg(F.min(order).alias("__first"))
    ranked = firsts.withColumn("__n", F.row_number().over(Window.partitionBy(session).orderBy("__first", value))).drop("__first")
    return rows.join(ranked, [session, value]).withColumn("allowed", F.col("__n") <= most).drop("__n")


def rates(rows: DataFrame, at: str, key: str, most: int, width: str = "60 seconds") -> DataFrame:
    """key, start, n and over of each window of time."""
    counted = rows.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("over"))
