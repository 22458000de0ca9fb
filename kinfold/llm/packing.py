"""Problem 7: filling containers of fixed capacity with texts measured in tokens."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch


def default_tokenizer() -> tuple[str, str]:
    """(path of the vocabulary as ranks, split pattern) of a public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _counter(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """(key, n_tokens) of every row, over the whole text; NULL and empty texts have 0 tokens."""
    path, pattern = tokenizer or default_tokenizer()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for batch in batches:
            encoding = encoding or _counter(path, pattern)
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


# -- planning -------------------------------------------------------------------------------------------------


@dataclass
class Plan:
    """patterns[i] = {length: copies in one container}; times[i] containers are filled so."""

    capacity: int
    patterns: list[dict[int, int]]
    times: list[int]


class _Stock:
    """How many items of each length are left, with an index of the sums that two of them can have.

    The index counts pairs of lengths by their sum: made once by a convolution, then kept up as lengths run out,
    by one subtraction over the lengths that are left.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.there = self.left > 0
        self.sums: np.ndarray | None = None

    def pair(self, gap: int, left: np.ndarray) -> tuple[int, int] | None:
        """Two available lengths of that sum, the most unlike ones: the longer of them is the harder to place."""
        if gap < 2 or gap > 2 * (len(left) - 1):
            return None
        a = np.arange(max(1, gap - len(left) + 1), gap // 2 + 1)
        both = (left[a] > 0) & (left[gap - a] > 0)
        if len(a) and gap % 2 == 0:
            both[-1] = left[a[-1]] > 1
        best = int(both.argmax()) if len(a) else 0
        return (int(a[best]), int(gap - a[best])) if len(a) and both[best] else None

    def index(self, held: list[int]) -> np.ndarray:
        """Pairs of lengths of each sum, those of `held` items that are only lent out among them: never too few."""
        size = len(self.left)
        now = self.left > 0
        now[held] = True
        gone = np.flatnonzero(self.there & ~now)
        if self.sums is None or len(gone) > 64:
            self.there = now
            room = 1 << (2 * size).bit_length()
            spectrum = np.fft.rfft(now.astype(np.float64), room)
            self.sums = np.rint(np.fft.irfft(spectrum * spectrum, room)[: 2 * size]).astype(np.int64)
        else:
            for n in gone:
                self.sums[n : n + size] -= 2 * self.there
                self.sums[2 * n] += 1
                self.there[n] = False
        return self.sums

    def exact(self, gap: int, left: np.ndarray, most: int, held: list[int] = ()) -> list[int] | None:
        """One to `most` (three at most) available lengths that fill the gap exactly; None only if there are none."""
        top = len(left) - 1
        if gap <= top and left[gap] > 0:
            return [gap]
        if most >= 2 and (two := self.pair(gap, left)):
            return list(two)
        if most < 3 or gap < 3:
            return None
        sums = self.index(list(held))
        a = np.arange(1, min(top, gap - 2) + 1)
        rest = gap - a
        ok = (left[a] > 0) & (rest < len(sums)) & (sums[np.minimum(rest, len(sums) - 1)] > 0)
        # A pair of the index may need two of a length of which there is one, so all are tried, longest first.
        for x in a[ok][::-1]:
            left[x] -= 1
            two = self.pair(int(gap - x), left)
            left[x] += 1
            if two:
                return [int(x), *two]
        return None


#: Items spent on a gap at first and when closing: each makes a plan of its own.
WAYS = ((3, 3), (2, 2), (1, 3), (1, 2), (1, 1))


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """Containers for counts[n] items of n tokens each, n = 1..capacity, as patterns and how often each is used.

    Filling gaps by two or three items leaves no space, but spends short items that others will miss; which matters
    more depends on the lengths. So plans that spend one to three on a gap, at first and when closing, are all made
    and the one of fewest containers is taken, the first of equals.
    """
    return min((_plan(counts, capacity, *way) for way in WAYS), key=lambda p: sum(p.times))


def _plan(counts: np.ndarray, capacity: int, at_first: int, closing: int) -> Plan:
    """One plan. First exact complements: each length, longest first, with one, two or three others that fill its gap to
    the last token, as often as the stock allows. Then best fit for what is left: the longest item, then
    again and again the longest that fits, closing exactly as soon as one to three items can. A pattern is
    used until it exhausts a length, so the work depends on the number of distinct lengths, not of items.
    """
    stock = _Stock(counts)
    left = stock.left
    out = Plan(capacity, [], [])

    def take(lengths: list[int]) -> None:
        need = Counter(lengths)
        times = min(int(left[n]) // c for n, c in need.items())
        for n, c in need.items():
            left[n] -= c * times
        out.patterns.append(dict(need))
        out.times.append(times)

    for n in range(capacity, 0, -1):
        while left[n] > 0:
            if n == capacity:
                take([n])
                continue
            left[n] -= 1
            rest = stock.exact(capacity - n, left, at_first, [n])
            left[n] += 1
            if rest is None:
                break
            take([n, *rest])
    for n in range(capacity, 0, -1):
        while left[n] > 0:
            used = [n]
            left[n] -= 1
            gap = capacity - n
            while gap > 0:
                fit = np.flatnonzero(left[1 : gap + 1])
                if not len(fit):
                    break
                longest = int(fit[-1]) + 1
                rest = stock.exact(gap, left, closing, used) if gap <= closing * longest else None
                # The longest that fits, as often as one pattern can have it.
                more = rest if rest is not None else [longest] * max(1, min(int(left[longest]), gap // longest - 3))
                for x in more:
                    left[x] -= 1
                    gap -= x
                used += more
            for x in used:
                left[x] += 1
            take(used)
    return out


def _slots(p: Plan) -> dict[str, list[int]]:
    """Which item numbers of every length go where: numbers start.. of n, `copies` to a container, from `box` and `slot` on."""
    out: dict[str, list[int]] = {c: [] for c in ("n", "start", "size", "copies", "box", "slot")}
    used: Counter[int] = Counter()
    box = 0
    for pattern, times in zip(p.patterns, p.times, strict=True):
        slot = 0
        for n, c in sorted(pattern.items(), reverse=True):
            for name, x in zip(out, (n, used[n], c * times, c, box, slot), strict=True):
                out[name].append(x)
            used[n] += c * times
            slot += c
        box += times
    return out


def _planned(rows):
    """One way of filling the containers of one budget."""
    import pandas as pd

    capacity, way = int(rows["c"].iloc[0]), int(rows["way"].iloc[0])
    counts = np.zeros(capacity + 1, np.int64)
    counts[rows["n"].to_numpy()] = rows["count"].to_numpy()
    p = _plan(counts, capacity, *WAYS[way])
    return pd.DataFrame(_slots(p)).assign(b=int(rows["b"].iloc[0]), way=way, boxes=sum(p.times))


def _number(width: int):
    """Numbers the items of each (budget, length) within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            key = batch.column("b").to_numpy().astype(np.int64) * width + batch.column("n").to_numpy()
            order = np.argsort(key, kind="stable")
            kinds, start, count = np.unique(key[order], return_index=True, return_counts=True)
            before = np.array([seen.get(int(x), 0) for x in kinds], np.int64)
            place = np.empty(len(key), np.int64)
            place[order] = np.arange(len(key)) - np.repeat(start, count) + np.repeat(before, count)
            seen.update(zip(kinds.tolist(), (before + count).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(key), part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"]
            )

    return run


def pack(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id", budget_key: str = "budget_id", capacity: str = "capacity_tokens") -> DataFrame:
    """(budget_id, container_id, slot, key, piece_no, start_token, n_tokens): every token of every row once per budget.

    sizes has (key, n_tokens). A text longer than the capacity is cut into pieces of the whole capacity and a
    rest; no other is. Containers are numbered from 0 per budget, items in one by slot from 0.

    A budget's histogram of lengths, at most `capacity` rows whatever the corpus, is planned in a task, one task
    for each way of spending items on gaps (see `plan`); the way of fewest containers is taken. Items are numbered
    among those of their length: by their place within a partition plus the count of earlier partitions. They
    meet the plan in an equi-join on (budget, length, block of 256 numbers), so no length is hot, no item meets
    another, and neither items nor plans come to the driver.

    Rows with NULL or 0 tokens take no part; budgets with a NULL capacity or one below 1 are skipped. Repeated keys
    are items each. Empty tables give no rows. Other columns are ignored. Budgets are parameters: their rows are
    read on the driver. Planning takes memory and time in proportion to a capacity and the number of different
    lengths, not to the items.
    """
    spark = sizes.sparkSession
    limits = {r[0]: r[1] for r in budgets.where(F.col(capacity) >= 1).select(budget_key, capacity).distinct().collect()}
    scratch = Scratch(spark, "pack")
    ids = sorted(limits)
    spec = F.array(*[F.struct(F.lit(i).alias("b"), F.lit(limits[x]).cast("long").alias("c")) for i, x in enumerate(ids)])
    if not ids:
        spec = F.from_json(F.lit("[]"), "array<struct<b:int,c:long>>")
    kind = dict(sizes.dtypes)[key]
    items = (
        sizes.where(F.col("n_tokens") >= 1)
        .select(F.col(key).alias("k"), "n_tokens", F.explode(spec).alias("s"))
        .select("k", "n_tokens", "s.b", "s.c")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.col("c")))))
        .select("k", "b", "c", "piece", (F.col("piece") * F.col("c")).alias("at"), F.least("c", F.col("n_tokens") - F.col("piece") * F.col("c")).alias("n"))
    )
    numbered = scratch.keep(items.mapInArrow(_number(max(limits.values(), default=0) + 1), f"k {kind}, b int, c long, piece long, at long, n long, part int, place long"))
    tally = scratch.keep(numbered.groupBy("part", "b", "c", "n").agg(F.count(F.lit(1)).alias("count")))
    lengths = tally.groupBy("b", "c", "n").agg(F.sum("count").alias("count")).withColumn("way", F.explode(F.lit(list(range(len(WAYS))))))
    # Spread one budget and way a task: they are few, and each takes its time.
    tasks = lengths.repartition(max(1, len(ids) * len(WAYS)), "b", "way").groupBy("b", "way")
    plans = scratch.keep(tasks.applyInPandas(_planned, "b int, way int, boxes long, n long, start long, size long, copies long, box long, slot long"))
    best = plans.groupBy("b").agg(F.min(F.struct("boxes", "way"))["way"].alias("way"))
    block = lambda number: F.floor(number / 256)
    slots = plans.join(best, ["b", "way"]).withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("size") - 1))))
    earlier = Window.partitionBy("b", "n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("part", "b", "n", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    placed = numbered.join(offsets, ["part", "b", "n"]).withColumn("number", F.col("place") + F.col("offset"))
    placed = placed.withColumn("block", block(F.col("number"))).join(slots.drop("way", "boxes"), ["b", "n", "block"])
    nth = F.col("number") - F.col("start")
    placed = placed.where((nth >= 0) & (nth < F.col("size")))
    names = F.array(*[F.lit(x) for x in ids]) if ids else F.array(F.lit(None).cast(dict(budgets.dtypes)[budget_key]))
    return placed.select(
        F.get(names, F.col("b")).alias(budget_key),
        (F.col("box") + F.floor(nth / F.col("copies"))).alias("container_id"),
        (F.col("slot") + nth % F.col("copies")).cast("int").alias("slot"),
        F.col("k").alias(key),
        F.col("piece").cast("int").alias("piece_no"),
        F.col("at").alias("start_token"),
        F.col("n").alias("n_tokens"),
    )


def pack_documents(documents: DataFrame, budgets: DataFrame, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Whole texts of documents put into sequences of every budget's capacity (see `pack`)."""
    sizes = Scratch(documents.sparkSession, "tokens").keep(token_counts(documents, tokenizer=tokenizer))
    return pack(sizes, budgets)
