"""Problem 4: the best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_score(score: Column) -> Column:
    """The score, or NULL where it is missing: NULL, not a number, or outside 0 to 1."""
    return F.when(~F.isnan(score) & score.between(0.0, 1.0), score + F.lit(0.0))


def best_of_group(
    df: DataFrame,
    group: str = "group_id",
    key: str = "id",
    preferences: list[Column] | None = None,
    least: int = 2,
) -> DataFrame:
    """(group, key) of the first row of every group by the preferences, highest first, then by smallest key.

    Ranking is a window row_number. Only two rows of a group can matter (the winner, and one more to
    tell that the group has two), so the filter on the rank is turned by Spark into a group limit that
    runs before the shuffle: every map task sends at most `least` rows of a group, however many it
    holds, and no group is gathered in one task.

    Preferences are Columns, NULL meaning missing; missing sorts last. The default is the manifest's:
    score, exif_tag_count, gps_present, file_size_bytes. Groups NULL or '' are no groups. Groups of
    fewer than `least` rows give nothing. Repeated rows (equal keys too) count as rows each and give
    one result row. An empty input gives no rows. Other columns are ignored.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    if preferences is None:
        preferences = [
            valid_score(F.col("score")),
            F.when(F.col("exif_tag_count") >= 0, F.col("exif_tag_count")),
            F.col("gps_present"),
            F.when(F.col("file_size_bytes") >= 1, F.col("file_size_bytes")),
        ]
    names = [f"p{i}" for i in range(len(preferences))]
    rows = df.where(F.col(group).isNotNull() & (F.col(group) != "")).select(
        F.col(group).alias("g"), F.col(key).alias("k"), *[p.alias(n) for p, n in zip(preferences, names, strict=True)]
    )
    order = Window.partitionBy("g").orderBy(*[F.col(n).desc_nulls_last() for n in names], F.col("k").asc_nulls_last())
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= least)
    full = F.count(F.lit(1)).over(Window.partitionBy("g"))
    return (
        kept.withColumn("n", full)
        .where((F.col("rank") == 1) & (F.col("n") >= least))
        .select(F.col("g").alias(group), F.col("k").alias(key))
    )


def merged_survivor(df: DataFrame, group: str, fields: list[str], trust: list[Column]) -> DataFrame:
    """One built record per group: each field from the most trusted row in which it is not NULL.

    max_by over a struct of the trust Columns keeps one candidate per field and map task, so a hot
    group costs no more than a small one. Ties take the greater value of the field, so the result does
    not depend on row order. A field NULL in all rows is NULL. Groups NULL or '' are no groups.
    """
    rank = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(trust)])
    rows = df.where(F.col(group).isNotNull() & (F.col(group) != ""))
    best = [F.max(F.when(F.col(f).isNotNull(), F.struct(rank.alias("r"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return rows.groupBy(group).agg(*best)
