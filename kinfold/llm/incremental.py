"""Problem 1: deduplicating new batches against all accepted history.

Pivots and what they prune
--------------------------
A 64-bit hash is read as four 16-bit words. By the pigeonhole principle two hashes at most r bits apart are at
most t_w bits apart in some word w, for any thresholds with sum(t_w + 1) > r; for r = 6 these are 1, 1, 1, 0.

A word is four parts of four bits, and each part has three fixed pivots: 0000, 0011 and 0101. The pivot table
stores, for each word of each accepted hash, the twelve distances of its parts to their pivots, three bits each,
as one ordered number. The table lies in the shared folder in cells, ranges of that number, each sorted by it.

By the triangle inequality a hash within t of a new one in a word has distances within t of the new one's, and
as parts are apart, the largest changes of the parts add up to t at most. For t = 1 all distances of three parts
are the same, and in the fourth, where one bit differs, each of the three changes by one. These bands are some
18 values of a word's number out of 50,625 (three distances leave 15 of 16 parts apart): a new hash meets some
0.1 % of the history. What meets is verified by the true distance on all 64 bits.

Pivots of the whole 64-bit space would prune nothing: distances of unrelated hashes to any point crowd around 32
with a deviation of 4, so a band of 6 to either side holds most of the history.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashes import bits_apart, digest, usable_hash
from ..operators.components import components
from ..runtime import Scratch

WORDS = 4
# The pivots of four bits.
PIVOTS = (0b0000, 0b0011, 0b0101)
#: The distances that four bits can have, as three numbers of three bits, in order.
_SEEN = sorted({sum((x ^ p).bit_count() << 3 * (2 - i) for i, p in enumerate(PIVOTS)) for x in range(16)})
#: As many probes as may be broadcast: some 50 MB.
_PROBES = 1 << 21


def thresholds(radius: int) -> list[int]:
    """Bits each word may differ in so that no pair within `radius` is missed: as equal as can be, only 0 and 1 (-1: word unused)."""
    if not 0 <= radius <= 2 * WORDS - 1:
        raise ValueError(f"radius must be 0 to {2 * WORDS - 1}")
    return [(radius + 1 + WORDS - 1 - w) // WORDS - 1 for w in range(WORDS)]


def _distances(h: str) -> str:
    """Word w of hash h as the ordered number of its twelve distances, the word's own number before them."""
    part = lambda j: f"cast(shiftrightunsigned({h}, 60 - 16 * w - 4 * {j}) & 15 as int)"
    terms = [f"shiftleft(cast(bit_count({part(j)} ^ {p}) as bigint), {3 * (11 - 3 * j - i)})" for j in range(4) for i, p in enumerate(PIVOTS)]
    return f"shiftleft(cast(w as bigint), 36) | {' | '.join(terms)}"


def pivot_table(hashes: DataFrame, radius: int) -> DataFrame:
    """Adds word w and key k: a row of the pivot table for each used word of each row's hash h."""
    used = [F.lit(w) for w, t in enumerate(thresholds(radius)) if t >= 0]
    return hashes.withColumn("w", F.explode(F.array(*used))).withColumn("k", F.expr(_distances("h")))


def probes(queries: DataFrame, radius: int) -> DataFrame:
    """The queries with a row for each key k of the pivot table that can hold a hash within the radius of hash q.

    These are the keys within the bands: the word's own, and where it may differ in one bit, for each part and
    each way in which its three distances can change by one, the key changed so, if four bits can have it.
    """
    moves = [sum(s << 3 * (2 - i) for i, s in enumerate(signs)) for signs in product((-1, 1), repeat=len(PIVOTS))]
    # As text: one expression to parse instead of hundreds of calls.
    steps = ", ".join(f"struct({9 * (3 - j)} as s, {m} as m)" for j in range(4) for m in moves)
    words = ", ".join(f"struct({w} as w, {t} as t)" for w, t in enumerate(thresholds(radius)) if t >= 0)
    rows = queries.select(*queries.columns, F.expr(f"inline(array({words}))")).withColumn("k", F.expr(_distances("q")))
    rows = rows.select(*queries.columns, "k", F.expr(f"inline(if(t = 1, array(struct(0 as s, 0 as m), {steps}), array(struct(0 as s, 0 as m))))"))
    seen = ", ".join(map(str, _SEEN))
    # A change that leaves the three bits of a distance is none that four bits can have either.
    return rows.where(f"m = 0 or (shiftrightunsigned(k, s) & 511) + m in ({seen})").select(*queries.columns, F.expr("k + shiftleft(cast(m as bigint), s)").alias("k"))


def close_pairs(queries: DataFrame, table: DataFrame, radius: int, found: DataFrame | None = None) -> DataFrame:
    """(q, h, bits, rest of the table's columns) of every pair of a distinct query hash q and a table row at most radius bits apart.

    The bands are spelled out, so they meet the table by equality of keys, which Spark may hash, sort or split at
    hot keys. A pair that meets in several words is reported by the first one only. found: the probes, if made.
    """
    apart = " ".join(f"when bit_count(shiftrightunsigned(q ^ h, {48 - 16 * w}) & 65535) <= {t} then {w}" for w, t in enumerate(thresholds(radius)) if t >= 0)
    found = probes(queries.select("q"), radius) if found is None else found
    met = table.join(found, "k").where(F.expr(f"bit_count(q ^ h) <= {radius} and w = case {apart} end"))
    return met.select("q", "h", bits_apart(F.col("q"), F.col("h")).alias("bits"), *[c for c in table.columns if c not in ("h", "w", "k", "cell")])


def fingerprints(df: DataFrame, key: str = "id", source_hash: str = "source_hash", phash: str = "phash") -> DataFrame:
    """(id, dg, ph): key, digest and usable hash of each row; NULL where absent or unusable."""
    return df.select(F.col(key).alias("id"), digest(F.col(source_hash)).alias("dg"), usable_hash(F.col(phash)).alias("ph"))


class History:
    """The accepted rows: smallest id of each digest, and the pivot table of each distinct usable hash.

    Both lie in one table, in cells, ranges of digests and of pivot keys, sorted, and are appended to. A
    batch reads the cells that its digests and bands reach, so what it reads depends on its own size and on that
    of a cell (cell_rows when the first rows are added), not on the rows behind them. `compact` joins the files
    that appending leaves in a cell.
    """

    def __init__(self, spark: SparkSession, path: str, radius: int = 6, cell_rows: int = 1 << 18):
        self.spark, self.path, self.radius, self.cell_rows = spark, path, radius, cell_rows
        self._cells: int | None = None

    @property
    def cells(self) -> int:
        """How many cells each word, and the digests, have."""
        if self._cells is None:
            self._cells = self.spark.read.schema("cells int").parquet(f"{self.path}/layout").first()[0]
        return self._cells

    def _pivot_cell(self) -> str:
        if self.cells == 1:
            return "cast(w as int)"
        rank = lambda j: f"array_position(array({', '.join(map(str, _SEEN))}), cast(shiftrightunsigned(k, {9 * (3 - j)}) & 511 as int)) - 1"
        place = " + ".join(f"({rank(j)}) * {15 ** (3 - j)}" for j in range(4))
        return f"cast(shiftrightunsigned(k, 36) * {self.cells} + ({place}) * {self.cells} div {15**4} as int)"

    def _digest_cell(self) -> str:
        return f"cast(conv(substring(dg, 1, 6), 16, 10) * {self.cells} div {16**6} as int)"

    def append(self, accepted: DataFrame) -> None:
        """Adds accepted rows (id, dg, ph)."""
        values = accepted.where(F.col("ph").isNotNull()).groupBy(F.col("ph").alias("h")).agg(F.min("id").alias("id"))
        first = self._cells is None
        if first:
            self._cells = max(1, -(-accepted.count() // self.cell_rows))
            self.spark.createDataFrame([(self._cells,)], "cells int").write.parquet(f"{self.path}/layout")
        digests = accepted.where(F.col("dg").isNotNull()).groupBy("dg").agg(F.min("id").alias("id")).withColumn("cell", F.expr(self._digest_cell()))
        table = pivot_table(values, self.radius).withColumn("cell", F.expr(self._pivot_cell() if self.cells > 1 else "w"))
        both = digests.withColumn("kind", F.lit("digests")).unionByName(table.withColumn("kind", F.lit("pivots")), allowMissingColumns=True)
        order = ["kind", "cell", "k", "dg"]
        if first:
            both = both.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *order)
        else:
            both = both.repartition("kind", "cell")
        both.sortWithinPartitions(*order).write.mode("append").partitionBy("kind", "cell").parquet(f"{self.path}/rows")

    def _read(self, kind: str, columns: list[str], reached: DataFrame | None) -> DataFrame:
        table = self.spark.read.schema("dg string, id long, h long, w int, k long, kind string, cell int").parquet(f"{self.path}/rows").where(F.col("kind") == kind)
        if reached is not None and self.cells > 1:
            # As many numbers as the table has cells at most.
            table = table.where(F.col("cell").isin([r[0] for r in reached.distinct().collect()]))
        return table.select(*columns, "cell")

    def digests(self, wanted: DataFrame | None = None) -> DataFrame:
        """(dg, id, cell), of the cells that the digests dg of `wanted` lie in."""
        return self._read("digests", ["dg", "id"], None if wanted is None else wanted.select(F.expr(self._digest_cell())))

    def pivots(self, found: DataFrame | None = None) -> DataFrame:
        """(h, id, w, k, cell), of the cells that the keys of some probes lie in."""
        return self._read("pivots", ["h", "id", "w", "k"], None if found is None or self.cells == 1 else found.select(F.expr(self._pivot_cell())))

    def compact(self, path: str) -> History:
        """The same history written anew at another path, one file a cell where a cell is not large, with cells for its present size."""
        out = History(self.spark, path, self.radius, self.cell_rows)
        values = self.pivots().groupBy("h").agg(F.min("id").alias("id"))
        rows = values.select("id", F.lit(None).cast("string").alias("dg"), F.col("h").alias("ph"))
        out.append(rows.unionByName(self.digests().select("id", "dg", F.lit(None).cast("long").alias("ph"))))
        return out


class _Near:
    """Accepted hashes by the words they have, to be asked for those within the radius of another."""

    def __init__(self, radius: int):
        self.radius = radius
        self.words = [(48 - 16 * w, [0, *(1 << i for i in range(16))] if t else [0]) for w, t in enumerate(thresholds(radius)) if t >= 0]
        self.held: list[dict[int, list[tuple[int, int]]]] = [{} for _ in self.words]

    def add(self, h: int, key: int) -> None:
        for (shift, _), held in zip(self.words, self.held, strict=True):
            held.setdefault(h >> shift & 65535, []).append((h, key))

    def of(self, h: int) -> tuple[int, int] | None:
        """(bits, key) of the nearest, the smallest key of equals."""
        best = None
        for (shift, flips), held in zip(self.words, self.held, strict=True):
            v = h >> shift & 65535
            for m in flips:
                for x, key in held.get(v ^ m, ()):
                    bits = (h ^ x).bit_count()
                    if bits <= self.radius and (best is None or (bits, key) < best):
                        best = bits, key
        return best


def _in_order(radius: int):
    """The rows of a whole batch or linked piece taken one after the other: a row is accepted unless it repeats an accepted one.

    same and near (with its bits) are what the history says; accepted_id is what the row repeats then.
    """

    def run(rows):
        rows = rows.sort_values("id")
        digests, near, out = {}, _Near(radius), []
        for key, dg, code, same, bits, old in zip(*(rows[c] for c in ("id", "dg", "code", "same", "bits", "old")), strict=True):
            h = None if code is None else int(code, 16)
            repeats = int(same) if same is not None else digests.get(dg) if dg is not None else None
            if repeats is None and h is not None:
                found = [x for x in (near.of(h), None if old is None else (int(bits), int(old))) if x]
                repeats = min(found)[1] if found else None
            if repeats is None:
                if dg is not None:
                    digests[dg] = key
                if h is not None:
                    near.add(h, key)
            out.append(None if repeats is None else str(repeats))
        return rows.assign(accepted_id=np.array(out, object))[["id", "dg", "ph", "accepted_id"]]

    return run


def _passed(rows: DataFrame, piece: Column, radius: int) -> DataFrame:
    """(id, dg, ph, accepted_id) by `_in_order`, piece by piece. Numbers that may be NULL travel as text: pandas would make them floats."""
    given = rows.select(piece.alias("piece"), "id", "dg", F.hex("ph").alias("code"), "ph", *[F.col(c).cast("string").alias(c) for c in ("same", "bits", "old")])
    run = _in_order(radius)
    texts = given.withColumn("ph", F.col("ph").cast("string")).groupBy("piece").applyInPandas(run, "id long, dg string, ph string, accepted_id string")
    return texts.select("id", "dg", F.col("ph").cast("long").alias("ph"), F.col("accepted_id").cast("long").alias("accepted_id"))


def _accepted(open_rows: DataFrame, radius: int, scratch: Scratch, piece_rows: int, rounds: int) -> DataFrame:
    """(dg, ph, id) of the rows that are accepted when all are taken in order of id, no history being near them.

    Rounds first: a row is found if an accepted earlier row is close, and accepted if no earlier close row is
    accepted or open, by minima per digest and hash value, never by pairs of rows. What a few rounds leave are
    chains; their linked pieces are taken one row after the other, each piece in a task of its own, the first
    piece_rows of it at a time. Then again, until nothing is open: each turn settles the first open row of
    every piece at least, so there is no limit to set and none is needed.
    """
    # Of rows alike in digest and hash only the first can be accepted.
    state = scratch.keep(open_rows.groupBy("dg", "ph").agg(F.min("id").alias("id")).withColumn("accepted", F.lit(False)))
    values = state.where(F.col("ph").isNotNull()).select(F.col("ph").alias("q")).distinct()
    links = close_pairs(values, pivot_table(values.select(F.col("q").alias("h")), radius), radius)
    links = scratch.keep(links.where("q <> h").select("q", "h"))
    far = F.lit(2**63 - 1)

    def around(state: DataFrame) -> DataFrame:
        """Adds the first accepted and the first open row that is close to each row or has its digest."""
        lows = [F.min(F.when(F.col("accepted"), F.col("id"))).alias("a"), F.min(F.when(~F.col("accepted"), F.col("id"))).alias("u")]
        by_dg = state.where(F.col("dg").isNotNull()).groupBy("dg").agg(*lows)
        by_ph = state.where(F.col("ph").isNotNull()).groupBy(F.col("ph").alias("h")).agg(*lows)
        next_to = links.join(by_ph, "h").select(F.col("q").alias("h"), "a", "u").union(by_ph)
        near = next_to.groupBy(F.col("h").alias("ph")).agg(F.min("a").alias("pa"), F.min("u").alias("pu"))
        seen = state.join(by_dg.select("dg", F.col("a").alias("da"), F.col("u").alias("du")), "dg", "left").join(near, "ph", "left")
        first = lambda x, y: F.least(F.coalesce(x, far), F.coalesce(y, far))
        return seen.withColumns({"first_accepted": first("da", "pa"), "first_open": first("du", "pu")})

    while True:
        for _ in range(rounds):
            step = around(state).where(F.col("accepted") | (F.col("first_accepted") > F.col("id")))
            after = scratch.keep(step.select("dg", "ph", "id", (F.col("accepted") | (F.col("first_open") >= F.col("id"))).alias("accepted")))
            scratch.drop(state)
            state = after
            if state.where(~F.col("accepted")).isEmpty():
                return state.where("accepted").select("dg", "ph", "id")
        left = scratch.keep(around(state).where(~F.col("accepted") & (F.col("first_accepted") > F.col("id"))).select("dg", "ph", "id"))
        named = left.select("id", F.concat(F.lit("d"), "dg").alias("v")).union(left.select("id", F.concat(F.lit("p"), F.col("ph").cast("string")).alias("v"))).where("v is not null")
        firsts = named.groupBy("v").agg(F.min("id").alias("low"))
        held = left.where(F.col("ph").isNotNull()).groupBy("ph").agg(F.min("id").alias("low"))
        between = links.join(held.select(F.col("ph").alias("q"), F.col("low").alias("x")), "q").join(held.select(F.col("ph").alias("h"), F.col("low").alias("y")), "h")
        pieces = components(named.join(firsts, "v").select(F.col("id").alias("x"), F.col("low").alias("y")).union(between.select("x", "y")), "x", "y")
        placed = left.join(pieces.withColumnRenamed("node", "id"), "id", "left").withColumn("piece", F.coalesce("component", "id")).drop("component")
        first = placed.withColumn("n", F.row_number().over(Window.partitionBy("piece").orderBy("id"))).where(F.col("n") <= piece_rows).drop("n")
        nothing = [F.lit(None).cast("long").alias(c) for c in ("same", "bits", "old")]
        done = scratch.keep(_passed(first.select("piece", "id", "dg", "ph", *nothing), F.col("piece"), radius).withColumn("accepted", F.col("accepted_id").isNull()))
        rest = left.join(done.select("id"), "id", "left_anti").select("dg", "ph", "id", F.lit(False).alias("accepted"))
        state = scratch.keep(state.where("accepted").union(rest).union(done.where("accepted").select("dg", "ph", "id", "accepted")))
        if state.where(~F.col("accepted")).isEmpty():
            return state.where("accepted").select("dg", "ph", "id")


def admit(batch: DataFrame, history: History, size: int | None = None, piece_rows: int = 1 << 20, rounds: int = 3) -> DataFrame:
    """Checks rows (id, dg, ph) in order of id against the history and against the rows accepted before them.

    Gives (id, dg, ph, accepted_id): accepted_id is NULL for a row that was accepted, else the row it repeats: the
    smallest accepted id of the same digest, or else the accepted hash the fewest bits apart, then the smallest id.

    What the history says is found first, over distinct values and by minima, so pairs are never held. Then the
    rows are taken in order: a batch of up to piece_rows rows (size, counted if not given) in one task, which is
    what bounds its memory; a larger one by rounds and linked pieces (see `_accepted`), after which all others
    meet what was accepted.

    Rows without digest and usable hash are accepted. Ids are unique. An empty batch gives no rows.
    """
    radius, spark = history.radius, history.spark
    scratch = Scratch(spark, "admit")
    size = batch.count() if size is None else size
    near = lambda pairs: pairs.groupBy("q").agg(F.min(F.struct("bits", F.col("id").alias("id"))).alias("near"))
    # Spread before each value becomes some 60 probes: by size alone they would all go to one task.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = batch.where(F.col("ph").isNotNull()).select(F.col("ph").alias("q")).repartition(parts, "q").distinct()
    found, wanted = probes(values, radius), batch.where(F.col("dg").isNotNull()).select("dg").distinct()
    if history.cells > 1:
        found = scratch.keep(found)
    old, digests = history.pivots(found), history.digests(wanted)
    if size * 60 <= _PROBES:
        found, wanted = F.broadcast(found), F.broadcast(wanted)
    near_old = near(close_pairs(values, old, radius, found))
    same = digests.join(wanted, "dg").groupBy("dg").agg(F.min("id").alias("same"))
    rows = batch.join(same, "dg", "left").join(near_old.withColumnRenamed("q", "ph"), "ph", "left").select("id", "dg", "ph", "same", "near")
    if size <= piece_rows:
        return scratch.keep(_passed(rows.select("id", "dg", "ph", "same", F.col("near.bits"), F.col("near.id").alias("old")), F.lit(0), radius))
    rows = scratch.keep(rows)
    open_rows = rows.where(F.col("same").isNull() & F.col("near").isNull() & (F.col("dg").isNotNull() | F.col("ph").isNotNull()))
    new = scratch.keep(_accepted(open_rows.select("id", "dg", "ph"), radius, scratch, piece_rows, rounds))
    new_dg = new.where(F.col("dg").isNotNull()).groupBy("dg").agg(F.min("id").alias("new_same"))
    new_ph = new.where(F.col("ph").isNotNull()).select(F.col("ph").alias("h"), F.col("id").alias("new_id"))
    by_digest = rows.join(new_dg, "dg", "left").withColumn("same", F.least("same", F.when(F.col("new_same") < F.col("id"), F.col("new_same"))))
    by_digest = by_digest.join(new.select("id", F.lit(True).alias("new")), "id", "left")
    # Accepted hashes are more than the radius apart from each other, so few of them surround any hash.
    around = close_pairs(values, pivot_table(new_ph, radius), radius, found).select(F.col("q").alias("ph"), "bits", "new_id")
    want = by_digest.where(F.col("same").isNull() & F.col("new").isNull() & F.col("ph").isNotNull()).select("id", "ph")
    new_near = want.join(around, "ph").where(F.col("new_id") < F.col("id")).groupBy("id").agg(F.min(F.struct("bits", F.col("new_id").alias("id"))).alias("new_near"))
    repeated = F.when(F.col("new").isNull() & (F.col("dg").isNotNull() | F.col("ph").isNotNull()), F.coalesce("same", F.least("near", "new_near")["id"]))
    return scratch.keep(by_digest.join(new_near, "id", "left").select("id", "dg", "ph", repeated.alias("accepted_id")))


def _batches(rows: DataFrame, key: str, batch: str) -> list[tuple[int, int]]:
    """The first id of each batch, in order, and how many rows it has. Batches whose ids overlap are one; one row a batch comes to the driver."""
    spans = rows.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.min(key), F.max(key)).collect()
    starts, reach = [], None
    for _, low, high in sorted(spans, key=lambda r: r[1]):
        if reach is None or low > reach:
            starts.append(low)
        reach = high if reach is None else max(reach, high)
    if not starts:
        return [(-(2**63), rows.count())]
    starts[0] = -(2**63)
    edges = F.array(*[F.lit(x).cast("long") for x in starts])
    counts = dict(rows.groupBy(F.size(F.filter(edges, lambda x: x <= F.col(key))).alias("n")).count().collect())
    return [(x, counts.get(i + 1, 0)) for i, x in enumerate(starts)]


def found_repeats(history_rows: DataFrame, incoming: DataFrame, radius: int = 6, batch: str = "batch_no") -> DataFrame:
    """(accepted_id, id) of every incoming row that repeats an accepted one, all history rows being accepted.

    Batches are taken in turn in order of id, and what each leaves accepted is appended to the history before the
    next. Rows without a batch go with the one in whose range of ids they lie; without the column all rows are one
    batch. The history is built once, from history_rows, and never worked through again.
    """
    spark = incoming.sparkSession
    history = History(spark, f"{Scratch(spark, 'history').root}/accepted", radius)
    history.append(fingerprints(history_rows))
    scratch = Scratch(spark, "incoming")
    rows = scratch.keep(fingerprints(incoming))
    batches = _batches(incoming, "id", batch) if batch in incoming.columns else [(-(2**63), incoming.count())]
    out = None
    for i, (start, size) in enumerate(batches):
        last = i + 1 == len(batches)
        own = rows.where(F.col("id") >= start)
        done = admit(own if last else own.where(F.col("id") < batches[i + 1][0]), history, size)
        if not last:
            history.append(done.where(F.col("accepted_id").isNull()).select("id", "dg", "ph"))
        # Else the driver's heap grows to its limit over what ended batches broadcast and planned.
        scratch.settle()
        found = done.where(F.col("accepted_id").isNotNull()).select("accepted_id", "id")
        out = found if out is None else out.unionByName(found)
    return out
