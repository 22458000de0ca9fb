"""Problem 6: the most similar hashes of every hash."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import usable_hash
from ..runtime import Scratch
from .graph import Graph, Layer, _nodes, build, search

_GRAPH = "shard long, mids binary, hashes binary, top binary, layers array<binary>, slots array<binary>"
_NEAR = "a long, b long, bits int"


def _build(degree: int, width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mid")
        values = rows["h"].to_numpy().view(np.uint64) if len(rows) else np.zeros(0, np.uint64)
        g = build(np.ascontiguousarray(values), degree, width)
        none = np.zeros(0, np.int32)
        return pd.DataFrame({
            "shard": [int(rows["shard"].iloc[0])],
            "mids": [rows["mid"].to_numpy(np.int64).tobytes()],
            "hashes": [g.values.tobytes()],
            "top": [g.top.astype(np.int64).tobytes()],
            "layers": [[x.neighbours.tobytes() for x in g.layers]],
            "slots": [[(none if x.slot is None else x.slot).tobytes() for x in g.layers]],
        })

    return run


def _search(degree: int, width: int, radius: int):
    def run(queries: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        a, b, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        if len(queries) and len(graphs):
            row = graphs.iloc[0]
            mids, values = np.frombuffer(row["mids"], np.int64), np.frombuffer(row["hashes"], np.uint64)
            layers = [
                Layer(np.frombuffer(n, np.int32).reshape(-1, degree), np.frombuffer(s, np.int32) if len(s) else None)
                for n, s in zip(row["layers"], row["slots"], strict=True)
            ]
            g = Graph(values, layers, np.frombuffer(row["top"], np.int64))
            mine, hashes = queries["mid"].to_numpy(np.int64), queries["h"].to_numpy(np.int64).view(np.uint64)
            for lo in range(0, len(mine), 4096):
                keys = search(g, hashes[lo : lo + 4096], width)
                close = (keys >> np.int64(40)) <= radius
                r, c = np.nonzero(close)
                other = mids[_nodes(keys[r, c])]
                keep = other != mine[lo + r]
                a.append(mine[lo + r][keep])
                b.append(other[keep])
                bits.append((keys[r, c] >> np.int64(40))[keep].astype(np.int32))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "bits": np.concatenate(bits)})

    return run


def _nearest_cells(hashes: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each hash, nearest first, ties by number."""
    order = np.arange(len(pivots), dtype=np.int64)
    out = np.empty((len(hashes), n), np.int64)
    step = max(1, (1 << 22) // len(pivots))
    for lo in range(0, len(hashes), step):
        code = np.bitwise_count(hashes[lo : lo + step, None] ^ pivots).astype(np.int64) << 32 | order
        if n < len(pivots):
            code = np.partition(code, n - 1, axis=1)[:, :n]
        out[lo : lo + step] = np.sort(code, axis=1) & ((1 << 32) - 1)
    return out


@dataclass
class _Map:
    """Which shards a hash lives in and visits: a cell around each pivot, cut into shards by hash where it holds many."""

    pivots: np.ndarray
    visits: int
    cuts: np.ndarray | None = None
    chunks: np.ndarray | None = None

    def hashes(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("h").to_numpy().view(np.uint64)

    def census(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many hashes live in and visit each cell."""
        size = len(self.pivots)
        for batch in batches:
            near = _nearest_cells(self.hashes(batch), self.pivots, self.visits)
            cells = np.unique(near)
            at, all_ = np.bincount(near[:, 0], minlength=size)[cells], np.bincount(near.ravel(), minlength=size)[cells]
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(at), pa.array(all_)], names=["cell", "homes", "visits"])

    def _base(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.cuts)))

    def homes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The one shard of each hash."""
        for batch in batches:
            h = self.hashes(batch)
            cell = _nearest_cells(h, self.pivots, 1)[:, 0]
            part = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % self.cuts[cell]
            yield pa.RecordBatch.from_arrays([batch.column("mid"), batch.column("h"), pa.array(self._base()[cell] + part)], names=["mid", "h", "shard"])

    def calls(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every shard that each hash visits, in the chunk of its visits that the hash falls into."""
        base = self._base()
        for batch in batches:
            h = self.hashes(batch)
            near = _nearest_cells(h, self.pivots, self.visits)
            times = self.cuts[near.ravel()]
            cell, row = np.repeat(near.ravel(), times), np.repeat(np.repeat(np.arange(len(h)), near.shape[1]), times)
            shard = base[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
            chunk = ((h[row] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % self.chunks[cell]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("mid").take(take), batch.column("h").take(take), pa.array(shard), pa.array(chunk)], names=["mid", "h", "shard", "chunk"])


def nearest_values(
    values: DataFrame, k: int, radius: int, shard_rows: int = 131_072, degree: int = 24, width: int = 32, visits: int = 24, chunk_rows: int = 1 << 20
) -> DataFrame:
    """(a, b, bits): of each distinct hash (mid, h), the k nearest others at most radius bits apart by (bits, mid).

    One pivot is taken from the hashes for every shard_rows of them, by a hash of the value, and every hash lives in the
    cell of its nearest pivot; a cell of more than twice shard_rows is cut into shards by hash. A navigable small-world
    graph is built per shard, in one task, and stored as flat arrays. Every hash visits the cells of its `visits` nearest
    pivots, all if there are no more, and their results are merged; a close pair counts for both of its hashes whichever
    of the two met it. So work grows with the hashes, at any number of them, and it is the same at every size.

    Of pairs up to 7 bits apart (uniform hashes, 1 to 7 bits equally often) 24 visits of either hash reach the other's
    cell for 1.00 at 40 cells, 0.997 at 256, 0.970 at 2,048 and 0.921 at 16,384 (2,000 million hashes). `width` is the beam
    of building and searching.

    A graph crosses the shuffle once for every chunk_rows visits of its shard: with the default, once but in crowds. Only
    pivots and two counts a cell, one per shard_rows hashes, come to the driver. `mid` numbers hashes and breaks ties.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "nearest")
    total = values.count()
    pivots = [r.h for r in values.select("h").orderBy(F.xxhash64("h"), "h").limit(max(1, -(-total // shard_rows))).collect()]
    if not pivots:
        return spark.createDataFrame([], _NEAR)
    where = _Map(np.array(pivots, np.int64).view(np.uint64), min(visits, len(pivots)))
    counted = values.select("h").mapInArrow(lambda it: where.census(it), "cell long, homes long, visits long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"))
    held = {r.cell: (r.homes, r.visits) for r in counted.collect()}
    size = lambda i, most: np.array([max(1, -(-held.get(c, (0, 0))[i] // most)) for c in range(len(pivots))], np.int64)
    where = _Map(where.pivots, where.visits, size(0, 2 * shard_rows), size(1, chunk_rows))
    homes = values.select("mid", "h").mapInArrow(lambda it: where.homes(it), "mid long, h long, shard long")
    calls = values.select("mid", "h").mapInArrow(lambda it: where.calls(it), "mid long, h long, shard long, chunk long")
    graphs = scratch.keep(homes.groupBy("shard").applyInPandas(_build(degree, width), _GRAPH))
    parts = spark.createDataFrame([(int(s), int(c)) for s, c in enumerate(np.repeat(where.chunks, where.cuts))], "shard long, chunks long")
    copies = graphs.join(parts, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    near = calls.groupBy("shard", "chunk").cogroup(copies.groupBy("shard", "chunk")).applyInPandas(_search(degree, width, radius), _NEAR)
    near = scratch.keep(near)
    scratch.drop(graphs)
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "bits"))
    order = Window.partitionBy("a").orderBy("bits", "b")
    return both.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["a", "b"]).select("a", "b", "bits")


def nearest_pairs(df: DataFrame, key: str = "id", phash: str = "phash", k: int = 5, radius: int = 7, **graph) -> DataFrame:
    """(id_a, id_b), smaller first, once each: rows of which one is among the k nearest of the other.

    The nearest of a row are the rows with usable hashes at most radius bits apart, by bits, then by key.
    Rows of equal hashes are one node of the graph (see `nearest_values`), known by their smallest key: of
    such a group only its first k + 1 keys can be anyone's nearest, so a hash held by a third of the rows
    adds k + 1 rows to the merging, and its own rows are joined to one list of k + 1.

    Rows with NULL, malformed or flat hashes pair with nothing; the stored distance is not used. Keys are
    unique. An empty input gives no rows. Other columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "pairs")
    rows = scratch.keep(df.select(F.col(key).cast("bigint").alias("id"), usable_hash(F.col(phash)).alias("h")).where("h is not null and id is not null"))
    values = scratch.keep(rows.groupBy("h").agg(F.min("id").alias("mid")))
    first = Window.partitionBy("h").orderBy("id")
    heads = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).select("h", "id")
    heads = scratch.keep(heads.join(values, "h").select("mid", "id"))
    near = nearest_values(values, k, radius, **graph)
    reach = near.union(values.select(F.col("mid").alias("a"), F.col("mid").alias("b"), F.lit(0).alias("bits")))
    lists = (
        reach.join(heads.withColumnRenamed("mid", "b"), "b")
        .withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("bits", "id")))
        .where(F.col("place") <= k + 1)
        .groupBy("a")
        .agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("near"))
    )
    # Every row's list is its hash's list without the row itself.
    own = rows.join(values, "h").select("id", F.col("mid").alias("a")).join(lists, "a")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    pairs = own.select("id", F.explode(others).alias("o")).select(F.least("id", "o.id").alias("id_a"), F.greatest("id", "o.id").alias("id_b"))
    return pairs.distinct()
