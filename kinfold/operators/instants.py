"""Problem 3: instants written in mixed notations, precisions and zones.

Two steps. `readings` spells out every valid interpretation of each text as an array, in the JVM, with one
match of one pattern per text. Where a text allows several (the order of day and month in dates with
slashes), `choose_readings` picks one per text by Viterbi over the record order of its source: a reading
costs what its evidence lacks, and a step costs more if the notation changes or time runs backward.
"""

from __future__ import annotations

import datetime
import zoneinfo
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

# The notations a reading can have.
NUMBER, YEAR_FIRST, YEAR_SLASH, DAY_SLASH, MONTH_SLASH, COMPACT, DAY_NAME, MONTH_NAME = range(8)
# What a step of the path costs, and a reading that its source's declared order speaks against: more than the steps
# to both sides of one record can, so the path follows a declared order, and finds the order where none is declared.
SWITCH, BACKWARD, UNDECLARED = 1.0, 1.0, 5.0
#: Records of one part of the record order, which one task holds in memory.
PART_ROWS = 1 << 20
_DAY_US = 86_400_000_000
#: Microseconds from 1601-01-01 to 1970-01-01.
_FROM_1601 = 11_644_473_600_000_000

_SPACE = "[\\s\\u00a0\\u2009\\u202f]"
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)"
#: Parts: year first with its separator, slashes, compact, day name month, month day; then the time, half of day, zone, zone name.
_DATE = (
    r"(?:(\d{4})([-:/.])(\d{1,2})\2(\d{1,2})"
    r"|(\d{1,2})/(\d{1,2})/(\d{4})"
    r"|(\d{4})(\d{2})(\d{2})(?=[t_ ]\d{6}(?!\d))"
    rf"|(?:[a-z]{{3,9}}\.?,?{_SPACE}+)?(\d{{1,2}}){_SPACE}+({_MONTH})\.?,?{_SPACE}+(\d{{4}})"
    rf"|(?:[a-z]{{3,9}}\.?,?{_SPACE}+)?({_MONTH})\.?{_SPACE}+(\d{{1,2}}),?{_SPACE}+(\d{{4}}))"
)
_TIME = r"(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?|(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?)"
_ZONE = rf"(?:{_SPACE}*(z|(?:utc|gmt)?[-+]\d{{1,2}}(?::?\d{{2}})?|[a-z]{{2,5}}))?(?:{_SPACE}*\[([a-z0-9_+/-]+)\])?"
_PATTERN = rf"^{_DATE}(?:[t_]|,?{_SPACE}+){_TIME}(?:{_SPACE}*([ap])\.?m\.?)?{_ZONE}$"
_PARTS = 27


def zone_abbreviations(zones: list[str], start: int = 1970, end: int = 2038) -> list[tuple[str, str, int]]:
    """(zone, abbreviation in lower case, offset in seconds) of every abbreviation in use in each zone, from the time zone database.

    An abbreviation that changed its offset within the years keeps the latest. Zones the database writes as
    numbers get the names people write.
    """
    # Names in common use where the database has none.
    spoken = {("Asia/Kathmandu", "npt"): 20700, ("Australia/Lord_Howe", "lhst"): 37800, ("Australia/Lord_Howe", "lhdt"): 39600}
    out = {}
    for name in zones:
        try:
            zone = zoneinfo.ZoneInfo(name)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError):
            continue
        for month in range((end - start) * 12):
            at = datetime.datetime(start + month // 12, month % 12 + 1, 15, tzinfo=zone)
            if at.tzname().isalpha():
                out[name, at.tzname().lower()] = int(at.utcoffset().total_seconds())
        out |= {k: v for k, v in spoken.items() if k[0] == name}
    return [(z, a, s) for (z, a), s in sorted(out.items())]


def _once(df: DataFrame) -> DataFrame:
    """The same rows; filters and projections on them are not moved below, where they would repeat the expressions above."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _micros(y: Column, m: Column, d: Column, clock: Column) -> Column:
    """Local microseconds as if in UTC; NULL for an impossible date."""
    zero = F.lit(0)
    day = F.to_date(F.call_function("try_make_timestamp_ntz", y, m, d, zero, zero, zero.cast("decimal(16,6)")))
    return F.when(y >= 1, F.unix_date(day).cast("bigint") * _DAY_US + clock)


def readings(rows: DataFrame, sources: DataFrame, value: str = "value", label: str = "source_label") -> DataFrame:
    """Adds `readings`: array<struct<epoch_us bigint, notation int, cost double>> of the valid interpretations of a text.

    sources has source_label, time_zone, date_order; labels are compared without letter case and outer
    blanks, of several alike the one that sorts first counts, and an unknown zone name is no zone. The array
    is empty for NULL, texts that are no date with a time, impossible dates or times, a local time whose label
    has no zone, and dates with slashes impossible in the declared order.

    Bare numbers: seconds, milliseconds, microseconds since 1970 or 100 ns since 1601, by magnitude (up to 11
    digits, 14, 17, more). A zone in the text counts before the label's: an offset, Z, a zone name in brackets,
    or an abbreviation, which has the meaning it has in the label's zone. A local time that occurs twice means
    the first, one that never occurs is read with the offset before the change.
    """
    spark = rows.sparkSession
    known = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    key = F.lower(F.trim(F.col("source_label")))
    declared = sources.where(F.col("source_label").isNotNull()).groupBy(key.alias("src_label")).agg(
        F.min(F.struct("source_label", "time_zone", "date_order")).alias("s")
    )
    declared = declared.select(
        "src_label", F.when(F.col("s.time_zone").isin(known), F.col("s.time_zone")).alias("src_zone"), F.upper(F.trim("s.date_order")).alias("src_order")
    )
    # At most one row a time zone name and abbreviation: bounded by the time zone database.
    names = zone_abbreviations(sorted(r[0] for r in declared.select("src_zone").distinct().where("src_zone is not null").collect()))
    spoken = F.create_map(*[x for z, a, s in names for x in (F.lit(f"{z} {a}"), F.lit(s))]) if names else F.lit(None).cast("map<string,int>")

    trimmed = F.regexp_replace(F.lower(F.col(value)), f"^{_SPACE}+|{_SPACE}+$", "")
    # The caller's columns travel as one, whatever their names.
    held = rows.select(F.struct("*").alias("_given"), F.lower(F.trim(F.col(label))).alias("src_label"), trimmed.alias("v"))
    joined = held.join(declared, "src_label", "left")
    marks = "\u0001".join(f"${i}" for i in range(1, _PARTS + 1))
    parts = F.split(F.regexp_replace("v", _PATTERN, marks), "\u0001")
    at = joined.withColumn("number", F.col("v").rlike(r"^\d+(\.\d+)?$"))
    at = at.withColumn("a", F.when(~F.col("number"), parts))
    at = at.withColumn("a", F.when(F.size("a") == _PARTS, F.col("a")))
    p = lambda i: F.col("a")[i - 1]
    first = lambda *ix: F.coalesce(*[F.when(p(i) != "", p(i)) for i in ix])
    hour, minute, second = _int(first(17, 21)), _int(first(18, 22)), F.coalesce(_int(first(19, 23)), F.lit(0))
    fraction = F.coalesce(_int(F.substring(F.rpad(first(20, 24), 9, "0"), 1, 6)), F.lit(0))
    at = at.withColumns({"h": hour, "mi": minute, "s": second, "us": fraction, "half": first(25), "zone": first(26), "named": first(27)})
    twelve = F.col("half").isNull() & (F.col("h") < 24) | F.col("h").between(1, 12)
    h24 = F.when(F.col("half").isNull(), F.col("h")).otherwise(F.pmod(F.col("h"), F.lit(12)) + F.when(F.col("half") == "p", 12).otherwise(0))
    clock = F.when(twelve & (F.col("mi") < 60) & (F.col("s") < 60), (h24.cast("bigint") * 3600 + F.col("mi") * 60 + F.col("s")) * 1_000_000 + F.col("us"))
    at = at.withColumn("clock", clock)
    month = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(first(12, 14), 1, 3)) + 2) / 3).cast("int")
    slash = p(5) != ""
    local = [
        (F.when(p(2) == "/", YEAR_SLASH).when(p(8) != "", COMPACT).when(p(11) != "", DAY_NAME).when(p(14) != "", MONTH_NAME).otherwise(YEAR_FIRST),
         _micros(_int(first(1, 8, 13, 16)), F.coalesce(_int(first(3, 9)), month), _int(first(4, 10, 11, 15)), F.col("clock"))),
        (F.when(slash, DAY_SLASH), _micros(_int(p(7)), _int(p(6)), _int(p(5)), F.col("clock"))),
        (F.when(slash, MONTH_SLASH), _micros(_int(p(7)), _int(p(5)), _int(p(6)), F.col("clock"))),
    ]
    # The zone: seconds of an offset, else the name of a zone.
    off = F.regexp_extract("zone", r"^(?:utc|gmt)?([-+])(\d{1,2}):?(\d{2})?$", 0)
    sign = F.when(F.regexp_extract("zone", "([-+])", 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(off, r"[^0-9]", "")
    hours = _int(F.when(F.length(digits) <= 2, digits).otherwise(F.expr("left(dg, length(dg) - 2)")))
    at = at.withColumn("dg", digits)
    minutes = F.coalesce(_int(F.when(F.length("dg") > 2, F.right(F.col("dg"), F.lit(2)))), F.lit(0))
    stated = (
        F.when(F.col("zone").isin("z", "utc", "gmt", "ut"), 0)
        .when(off != "", F.when((hours <= 18) & (minutes < 60), sign * (hours * 3600 + minutes * 60)))
        .otherwise(spoken[F.concat_ws(" ", "src_zone", "zone")])
    )
    spelled = {z.lower(): z for z in known}
    by_name = F.create_map(*[x for k, z in spelled.items() for x in (F.lit(k), F.lit(z))])[F.col("named")]
    at = at.withColumns({"offset": stated, "place": F.when(F.col("named").isNotNull(), by_name).otherwise(F.col("src_zone"))})
    at = at.withColumns({f"l{i}": us for i, (_, us) in enumerate(local)} | {f"n{i}": n for i, (n, _) in enumerate(local)})

    def instant(us: Column) -> Column:
        there = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), F.col("place")))
        return F.when(F.col("zone").isNotNull(), us - F.col("offset").cast("bigint") * 1_000_000).otherwise(F.when(F.col("place").isNotNull(), there))

    # Columns first, then the array from them: higher-order functions would evaluate all of this uncompiled.
    at = at.withColumns({f"i{i}": instant(F.col(f"l{i}")) for i in range(len(local))})
    at = at.withColumn("exact", F.when(F.col("number"), F.col("v").try_cast("decimal(30,6)")))
    size = F.length(F.floor("exact").cast("string"))
    counted = (
        F.when(size <= 11, F.floor(F.col("exact") * 1_000_000).try_cast("bigint"))
        .when(size <= 14, F.floor(F.col("exact") * 1000).try_cast("bigint"))
        .when(size <= 17, F.floor("exact").try_cast("bigint"))
        .when(size <= 19, F.floor(F.col("exact") / 10).try_cast("bigint") - _FROM_1601)
    )
    at = at.withColumn("counted", counted)
    order = F.col("src_order")

    def reading(us: str, notation: Column, against: str) -> Column:
        cost = F.when(order == against, UNDECLARED).otherwise(0.0) if against else F.lit(0.0)
        return F.struct(F.col(us).alias("epoch_us"), notation.cast("int").alias("notation"), cost.alias("cost"))

    day_first, month_first = reading("i1", F.lit(DAY_SLASH), "MDY"), reading("i2", F.lit(MONTH_SLASH), "DMY")
    # An order declared for the source that the date cannot have leaves no reading.
    day_fits = F.col("i1").isNotNull() & (F.coalesce(order, F.lit("")) != "YMD")
    month_fits = F.col("i2").isNotNull() & (F.coalesce(order, F.lit("")) != "YMD")
    one = lambda r: F.array(r)
    found = (
        F.when(F.col("counted").isNotNull(), one(reading("counted", F.lit(NUMBER), "")))
        .when(F.col("i0").isNotNull(), one(reading("i0", F.col("n0"), "")))
        .when(day_fits & month_fits & (F.col("i1") != F.col("i2")), F.array(day_first, month_first))
        .when(day_fits & F.coalesce((order != "MDY") | month_fits, F.lit(True)), one(day_first))
        .when(month_fits & F.coalesce(order != "DMY", F.lit(True)), one(month_first))
    )
    at = at.withColumn("readings", F.coalesce(found, F.from_json(F.lit("[]"), "array<struct<epoch_us:bigint,notation:int,cost:double>>")))
    return _once(at.select("_given.*", "readings"))


# -- choosing one reading -------------------------------------------------------------------------------------


def _steps(epoch_a: np.ndarray, kind_a: np.ndarray, epoch_b: np.ndarray, kind_b: np.ndarray) -> np.ndarray:
    """Costs of a step from each reading of one record to each of the next; a reading of kind -1 is none."""
    cost = (kind_a[:, None] != kind_b[None, :]) * SWITCH + (epoch_b[None, :] < epoch_a[:, None]) * BACKWARD
    return np.where((kind_a[:, None] < 0) | (kind_b[None, :] < 0), np.inf, cost)


def _scan(items: np.ndarray, op) -> np.ndarray:
    """items[0], items[0] op items[1], and so on, for an associative op over arrays of items, in a logarithmic number of calls."""
    n = len(items)
    if n < 2:
        return items.copy()
    pairs = _scan(op(items[: n - 1 : 2], items[1::2]), op)
    out = np.empty_like(items)
    out[0] = items[0]
    out[1::2] = pairs
    out[2::2] = op(pairs[: (n - 1) // 2], items[2::2])
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest costs through two parts of a path, one after the other."""
    return (a[:, :, :, None] + b[:, None, :, :]).min(2)


def _moves(epoch: np.ndarray, kind: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of all steps, and of each step with the reading it leads to."""
    switch = kind[:-1, :, None] != kind[1:, None, :]
    back = epoch[1:, None, :] < epoch[:-1, :, None]
    step = switch * SWITCH + back * BACKWARD
    step[(kind[:-1, :, None] < 0) | (kind[1:, None, :] < 0)] = np.inf
    return step, step + own[1:, None, :]


def viterbi(epoch: np.ndarray, kind: np.ndarray, cost: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """Cheapest path through records of k readings each (arrays n by k): the chosen reading of each record.

    start and end add costs to the readings of the first and last record (what neighbouring parts of the
    record order say). Of equal paths the one of smaller reading numbers from the end wins. The costs up to each
    record, and the way back, are prefix scans, so no step is made record by record.
    """
    n = len(epoch)
    own = np.where(kind < 0, np.inf, cost)
    first = own[0] + (0 if start is None else start)
    step, through = _moves(epoch, kind, own)
    best = np.concatenate([first[None], (first[None, :, None] + _scan(through, _joined)).min(1)]) if n > 1 else first[None]
    at = int((best[-1] + (0 if end is None else end)).argmin())
    if n == 1:
        return np.array([at])
    # Where the path to each reading of the next record comes from; composed from the end.
    back = (best[:-1, :, None] + step).argmin(1)
    from_end = _scan(back[::-1], lambda a, b: np.take_along_axis(b, a, 1))[::-1]
    return np.append(from_end[:, at], at)


def _through(epoch: np.ndarray, kind: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Cheapest cost through a part of the record order, from each reading of its first record to each of its last."""
    own = np.where(kind < 0, np.inf, cost)
    best = np.full((epoch.shape[1],) * 2, np.inf)
    np.fill_diagonal(best, own[0])
    if len(epoch) == 1:
        return best
    whole = _moves(epoch, kind, own)[1]
    while len(whole) > 1:
        odd = whole[len(whole) - len(whole) % 2 :]
        whole = np.concatenate([_joined(whole[: len(whole) - len(odd) : 2], whole[1::2]), odd])
    return _joined(best[None], whole)[0]


_K = 2


def _runs(src: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int, bool, bool]]:
    """(from, to, whether it opens its source here, whether it closes it here) of each stretch a path must be sought for.

    A record with one reading fixes the path, so stretches run from one such record to the next and only those
    with an undecided record between are given. The first and last stretch of a source in a part may go on
    outside it.
    """
    if not len(src):
        return
    edges = np.flatnonzero(np.diff(src)) + 1
    for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(src)])), strict=True):
        inner = np.flatnonzero(many[lo:hi]) + lo
        if not len(inner):
            continue
        groups = np.split(inner, np.flatnonzero(np.diff(inner) > 1) + 1)
        for g in groups:
            yield max(int(g[0]) - 1, lo), min(int(g[-1]) + 2, hi), int(g[0]) == lo, int(g[-1]) == hi - 1


def _columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return None
    t = pa.Table.from_batches(rows)
    num = lambda c: t.column(c).to_numpy()
    pair = lambda a, b: np.stack([num(a), num(b)], 1)
    return num("src"), num("rid"), pair("e0", "e1"), pair("n0", "n1"), pair("c0", "c1")


_SUMMARY, _CHOSEN, _OPEN = range(3)
_LAID = (
    "kind int, part int, src long, ord long, rid long, stretch int, e0 long, e1 long, n0 int, n1 int, c0 double, c1 double, "
    "f0 long, f1 long, m0 int, m1 int, w00 double, w01 double, w10 double, w11 double"
)


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one sorted part of the record order can say by itself.

    Chosen readings of stretches that lie inside it. Of its first and last source, which may go on in other
    parts: a summary (readings of the first and last record there, cheapest costs between them), and the
    records of stretches that reach the border, still open.
    """
    part = TaskContext.get().partitionId()
    got = _columns(batches)
    if not got:
        return
    src, rid, epoch, kind, cost = got
    names = [x.strip().split(" ")[0] for x in _LAID.split(",")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[x.strip().split(" ")[1]] for x in _LAID.split(",")]

    def batch(n: int, **cols) -> pa.RecordBatch:
        cols = {"part": np.full(n, part), **cols}
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, types, strict=True)], names=names)

    edges = np.flatnonzero(np.diff(src)) + 1
    ends = {(0, int(edges[0]) if len(edges) else len(src)), (int(edges[-1]) if len(edges) else 0, len(src))}
    for lo, hi in ends:
        fixed = np.flatnonzero(kind[lo:hi, 1] < 0) + lo
        if len(fixed):
            head, tail = slice(lo, fixed[0] + 1), slice(fixed[-1], hi)
            w = _through(epoch[head], kind[head], cost[head])[:, :1] + _through(epoch[tail], kind[tail], cost[tail])[:1, :]
        else:
            w = _through(epoch[lo:hi], kind[lo:hi], cost[lo:hi])
        at = {f"{c}{i}": [x[j, i]] for c, x, j in (("e", epoch, lo), ("n", kind, lo), ("f", epoch, hi - 1), ("m", kind, hi - 1)) for i in range(_K)}
        yield batch(1, kind=[_SUMMARY], src=[src[lo]], **at, **{f"w{i}{j}": [w[i, j]] for i in range(_K) for j in range(_K)})
    rows, chosen = [], []
    for lo, hi, opens, closes in _runs(src, kind[:, 1] >= 0):
        opens, closes = opens and lo == 0, closes and hi == len(src)
        if opens or closes:
            n, at = hi - lo, slice(lo, hi)
            pairs = {f"{c}{i}": x[at, i] for c, x in (("e", epoch), ("n", kind), ("c", cost)) for i in range(_K)}
            yield batch(n, kind=np.full(n, _OPEN), src=src[at], ord=np.arange(lo, hi), rid=rid[at], stretch=np.full(n, opens + 2 * closes), **pairs)
        else:
            path = viterbi(epoch[lo:hi], kind[lo:hi], cost[lo:hi])
            inner = kind[lo:hi, 1] >= 0
            rows.append(np.arange(lo, hi)[inner])
            chosen.append(epoch[lo:hi][inner, path[inner]])
    if rows:
        at = np.concatenate(rows)
        yield batch(len(at), kind=np.full(len(at), _CHOSEN), src=src[at], rid=rid[at], e0=np.concatenate(chosen))


def _outlook(edges):
    """The readings that one cheapest path of a source takes at the first and last record of each part."""
    import pandas as pd

    e = edges.sort_values("part")
    n = len(e)
    first, last = (e[["e0", "e1"]].to_numpy(), e[["n0", "n1"]].to_numpy()), (e[["f0", "f1"]].to_numpy(), e[["m0", "m1"]].to_numpy())
    within = e[["w00", "w01", "w10", "w11"]].to_numpy().reshape(n, _K, _K)
    steps = [_steps(last[0][i], last[1][i], first[0][i + 1], first[1][i + 1]) for i in range(n - 1)]
    reach, done = [np.zeros(_K)], []
    for i in range(n):
        done.append((reach[i][:, None] + within[i]).min(0))
        if i + 1 < n:
            reach.append((done[i][:, None] + steps[i]).min(0))
    opens, closes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    closes[-1] = int(done[-1].argmin())
    for i in range(n - 1, -1, -1):
        opens[i] = int((reach[i] + within[i][:, closes[i]]).argmin())
        if i:
            closes[i - 1] = int((done[i - 1] + steps[i - 1][:, opens[i]]).argmin())
    return pd.DataFrame({"part": e["part"].to_numpy(), "src": e["src"].to_numpy(), "opens": opens, "closes": closes})


def _close(outlooks):
    """Chooses along a stretch that reaches a border of its part, keeping to what the path takes there."""

    def run(rows):
        import pandas as pd

        rows = rows.sort_values("ord")
        epoch, kind, cost = (rows[[f"{c}0", f"{c}1"]].to_numpy() for c in "enc")
        view = outlooks.value.get((int(rows["part"].iloc[0]), int(rows["src"].iloc[0])))
        reach = int(rows["stretch"].iloc[0])
        forced = lambda i: np.where(np.arange(_K) == view[i], 0.0, np.inf)
        path = viterbi(epoch, kind, cost, forced(0) if view and reach & 1 else None, forced(1) if view and reach & 2 else None)
        inner = kind[:, 1] >= 0
        return pd.DataFrame({"rid": rows["rid"].to_numpy()[inner], "e0": epoch[inner, path[inner]]})

    return run


def choose_readings(rows: DataFrame, source: list[str], order: str) -> DataFrame:
    """Adds `epoch_us`, the chosen reading of each row, by Viterbi over each source's record order; drops rows without readings.

    source: the columns that make one stream of records; order: a BIGINT column. Rows of equal order in a stream, repeated
    ones too, count as records each and come out once each. Rows with NULL in order come out with their cheapest reading,
    the first of equals.

    Rows with one reading are decided and go straight through, so paths are sought only for the stretches between
    them. Readings are range-partitioned by (stream, order) and sorted, in parts of about PART_ROWS records or less, so one stream may fill many; each
    partition gives the cheapest costs between the readings at its ends (a 2 by 2 matrix per stream), these are
    chained per stream, at most one row a partition, to one cheapest path, whose readings at the borders each
    partition then keeps to. The path costs what a single pass over the stream would find. Rows of more than two readings keep the
    two cheapest, which loses none: dates with slashes have two at most.
    """
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "instants")
    ranked = F.array_sort("readings", lambda a, b: F.when(a["cost"] < b["cost"], -1).when(a["cost"] > b["cost"], 1).otherwise(a["notation"] - b["notation"]))
    best = F.when(F.size("readings") > 1, ranked).otherwise(F.col("readings"))
    held = scratch.keep(rows.where(F.size("readings") > 0).withColumn("readings", best).withColumn("_src", F.xxhash64(*source)).withColumn("_rid", F.monotonically_increasing_id()))
    pick = lambda i, f: F.try_element_at("readings", F.lit(i + 1))[f]
    # Streams without an undecided record have no path to seek; there are as many streams with one as sources and fields.
    streams = held.where((F.size("readings") > 1) & F.col(order).isNotNull()).select("_src").distinct()
    flat = held.where(F.col(order).isNotNull()).join(streams, "_src", "left_semi").select(
        F.col("_src").alias("src"),
        F.col(order).cast("bigint").alias("ord"),
        F.col("_rid").alias("rid"),
        *[F.coalesce(pick(i, "epoch_us"), F.lit(0).cast("bigint")).alias(f"e{i}") for i in range(_K)],
        *[F.coalesce(pick(i, "notation"), F.lit(-1)).alias(f"n{i}") for i in range(_K)],
        *[F.coalesce(pick(i, "cost"), F.lit(0.0)).alias(f"c{i}") for i in range(_K)],
    )
    if held.where(F.size("readings") > 1).isEmpty():
        return held.select(*[c for c in rows.columns if c != "readings"], F.col("readings")[0]["epoch_us"].alias("epoch_us"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-flat.count() // PART_ROWS))
    ranged = flat.repartitionByRange(parts, "src", "ord", "rid").sortWithinPartitions("src", "ord", "rid")
    # Written, so that the parts are the same for all that follows.
    laid = scratch.keep(ranged.mapInArrow(_part, _LAID))
    edges = laid.where(F.col("kind") == _SUMMARY).drop("kind", "ord", "rid", "stretch", "c0", "c1")
    shared = edges.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("src"))).where("n > 1").drop("n")
    # At most two streams of a part go on in another one, so this is bounded by the number of parts.
    views = shared.groupBy("src").applyInPandas(lambda pdf: _outlook(pdf), "part int, src long, opens long, closes long").collect()
    outlooks = spark.sparkContext.broadcast({(v.part, v.src): (v.opens, v.closes) for v in views})
    closed = laid.where(F.col("kind") == _OPEN).groupBy("part", "src", "stretch").applyInPandas(_close(outlooks), "rid long, e0 long")
    chosen = laid.where(F.col("kind") == _CHOSEN).select("rid", "e0").union(closed).select(F.col("rid").alias("_rid"), F.col("e0").alias("_chosen"))
    undecided = held.where((F.size("readings") > 1) & F.col(order).isNotNull()).join(chosen, "_rid")
    settled = held.where((F.size("readings") == 1) | F.col(order).isNull())
    names = rows.columns
    return (
        settled.select(*names, F.col("readings")[0]["epoch_us"].alias("epoch_us"))
        .unionByName(undecided.select(*names, F.col("_chosen").alias("epoch_us")))
        .drop("readings")
    )


def sidecar_time(raw: Column) -> Column:
    """photoTakenTime.timestamp of a sidecar's JSON text; NULL if the text is not one valid JSON value, or has no such field."""
    # Inside brackets, so that anything after the value makes the text invalid.
    parsed = F.call_function("try_parse_json", F.concat(F.lit("["), raw, F.lit("]")))
    one = F.call_function("try_variant_get", parsed, F.lit("$[1]"), F.lit("string")).isNull()
    return F.when(one, F.call_function("try_variant_get", parsed, F.lit("$[0].photoTakenTime.timestamp"), F.lit("string")))


def manifest_instants(manifest: DataFrame, sidecars: DataFrame, sources: DataFrame) -> DataFrame:
    """(rec_id, field, epoch_us) of every readable date of the manifest and of the sidecars.

    A stream is what one source, its label without letter case and outer blanks, wrote into one field, in order of
    the record's id. Dates with slashes are a stream apart, so that a switch of their order is seen across records
    of other notations, which have one reading and say nothing about it. Repeated rows count as rows each. Empty
    tables give no rows; other columns are ignored.
    """
    dates = ["shot_date", "creation_date", "mtime"]
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("field"), F.col(d).cast("string").alias("value")) for d in dates])).alias("f")
    ours = manifest.select(F.col("id").alias("rec_id"), "source_label", each).select("rec_id", "source_label", "f.*")
    theirs = sidecars.select(
        F.col("sidecar_id").alias("rec_id"), "source_label", F.lit("photo_taken").alias("field"), sidecar_time(F.col("raw")).alias("value")
    )
    read = readings(ours.unionByName(theirs).where(F.col("value").isNotNull()), sources).drop("value")
    slashes = F.try_element_at("readings", F.lit(1))["notation"].isin(DAY_SLASH, MONTH_SLASH)
    streams = read.withColumns({"label": F.lower(F.trim("source_label")), "slashes": slashes})
    return choose_readings(streams, ["label", "field", "slashes"], "rec_id").select("rec_id", "field", "epoch_us")
