"""Reading a ladder of measured rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def knee(rates: DataFrame, by: str = "device", gain: float = 0.15, cap: int = 8) -> DataFrame:
    """(by, knee): the first concurrency of 1, 2, 4, 8 whose doubling gains less than `gain`; the largest in the ladder if all gain.

    rates: by, concurrency, rate. NULL where the ladder does not start with a clean doubling or a rate within it is NULL or not
    above 0. The ladder ends at the first gap. At most four rows a device, so the windows are small.
    """
    steps = rates.where(F.col("concurrency").isin(1, 2, 4, 8) & (F.col("concurrency") <= cap)).groupBy(by, "concurrency").agg(F.max("rate").alias("rate"))
    w = Window.partitionBy(by).orderBy("concurrency")
    paired = steps.select(by, "concurrency", "rate", F.lead("concurrency").over(w).alias("next"), F.lead("rate").over(w).alias("faster"))
    gap = (F.col("next") != 2 * F.col("concurrency")) | F.col("next").isNull()
    marked = paired.withColumn("ended", F.max(gap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = ~F.col("ended")
    bad = inside & ~F.coalesce((F.col("rate") > 0) & (F.col("faster") > 0), F.lit(False))
    flat = inside & ~bad & (F.col("faster") / F.col("rate") - 1 < gain)
    found = marked.groupBy(by).agg(F.min(F.when(bad, F.col("concurrency"))).alias("b"), F.min(F.when(flat, F.col("concurrency"))).alias("f"), F.max(F.when(inside, F.col("next"))).alias("m"))
    return found.select(by, F.when(F.col("f") < F.coalesce("b", F.lit(99)), F.col("f")).when(F.col("b").isNull(), F.col("m")).alias("knee"))
