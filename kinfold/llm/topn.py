"""Problem 5: the first N rows of every group, by exact positions in one global sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

_OUT = "part int, g string, pos long, k long, n long"


def _positions(limit: int):
    """Numbers the rows of each group within one sorted partition and keeps the first `limit` of each.

    Besides the kept rows the partition's counts of its first and last group come out (n not NULL):
    only those groups can go on in another partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group, count, first = None, 0, None
        schema = pa.schema([("part", pa.int32()), ("g", pa.string()), ("pos", pa.int64()), ("k", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            g = batch.column(0)
            g = g.cast(pa.string()) if g.type != pa.string() else g
            start = np.ones(size, dtype=bool)
            start[1:] = pc.not_equal(g.slice(1), g.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            head = g[0].as_py()
            if group is not None and head == group:
                start[0] = False
            at = np.arange(size, dtype=np.int64)
            begin = np.maximum.accumulate(np.where(start, at, -1))
            pos = np.where(begin < 0, at + count, at - begin)
            if first is None and group is not None and start[0]:
                first = (group, count)
            if first is None and start[1:].any():
                # the partition's first group ends in this batch
                end = int(np.flatnonzero(start[1:])[0]) + 1
                first = (head, int(pos[end - 1]) + 1)
            group, count = g[size - 1].as_py(), int(pos[-1]) + 1
            keep = np.flatnonzero(pos < limit)
            take = pa.array(keep)
            m = len(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part, np.int32)), g.take(take), pa.array(pos[keep]), batch.column(1).take(take), pa.nulls(m, pa.int64())],
                schema=schema,
            )
        ends = {x for x in (first, (group, count) if group is not None else None) if x}
        if ends:
            names, counts = zip(*sorted(ends), strict=True)
            m = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * m, pa.int32()), pa.array(names, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(counts, pa.int64())],
                schema=schema,
            )

    return run


def top_n_per_group(df: DataFrame, n: int, group: str = "group_id", score: Column | None = None, key: str = "id") -> DataFrame:
    """(group, rank_no, key): the first n rows of every group by score descending, then key ascending, from 1.

    The rows' three columns are range-partitioned by (group, score, key) and sorted, so a group of any
    size is spread over as many tasks as its rows need. Each partition numbers its own rows; the counts
    of groups that cross a partition border are prefix-summed and added, which gives exact positions
    without gathering a group anywhere. The summed table has at most two rows a partition and is
    broadcast for that reason.

    Rows whose group is NULL or '' or whose score Column is NULL take no part. Keys are BIGINT; equal
    keys (repeated rows) keep separate ranks in arbitrary but equal-looking order. n < 1 gives no rows,
    an empty input gives no rows, other columns are ignored.
    """
    from .survivor import valid_score

    score = valid_score(F.col("score")) if score is None else score
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(key).cast("bigint").alias("k"), score.alias("s")).where(
        F.col("g").isNotNull() & (F.col("g") != "") & F.col("s").isNotNull() & F.col("k").isNotNull()
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("g"), F.col("s").desc(), F.col("k")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("g", "k")
    scratch = Scratch(spark, "topn")
    local = scratch.keep(ranged.mapInArrow(_positions(max(n, 0)), _OUT))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        local.where(F.col("n").isNotNull())
        .select("part", "g", F.sum("n").over(before).alias("offset"))
        .where(F.col("offset") > 0)
    )
    return (
        local.where(F.col("n").isNull())
        .join(F.broadcast(offsets), ["part", "g"], "left")
        .select(
            F.col("g").alias(group),
            (F.col("pos") + F.coalesce(F.col("offset"), F.lit(0)) + 1).cast("int").alias("rank_no"),
            F.col("k").alias(key),
        )
        .where(F.col("rank_no") <= n)
    )
