import datetime
import itertools
import random
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators.instants import BACKWARD, SWITCH, UNDECLARED, _through, choose_readings, manifest_instants, readings, sidecar_time, viterbi, zone_abbreviations

SOURCES = [("Home", "Europe/Berlin", "DMY"), ("usa", "America/New_York", "MDY"), ("tokyo", "Asia/Tokyo", "YMD"), ("open", "UTC", None), ("howe", "Australia/Lord_Howe", "DMY"), ("bad", "Mars/Base", "DMY")]


def us(text, zone="UTC"):
    at = datetime.datetime.fromisoformat(text).replace(tzinfo=zoneinfo.ZoneInfo(zone))
    d = at.astimezone(datetime.UTC) - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


CASES = [
    ("home", "2020-07-01T12:00:00", us("2020-07-01T10:00:00")), (" HOME ", "2020:01:01 12:00:00.25", us("2020-01-01T11:00:00.250")), ("home", "2020:01:01 12:00:00,5", us("2020-01-01T11:00:00.500")),
    ("home", "03/04/2020 10:00:00", us("2020-04-03T08:00:00")), ("usa", "03/04/2020 10:00:00", us("2020-03-04T15:00:00")), ("usa", "12/31/2019 11:59 PM", us("2020-01-01T04:59:00")),
    ("usa", "Apr 10, 2022, 2:54:02 AM", us("2022-04-10T06:54:02")), ("usa", "Apr 10, 2022, 12:54:02 am", us("2022-04-10T04:54:02")), ("usa", "1 Apr 2012 02:35:23", us("2012-04-01T06:35:23")),
    ("usa", "Sun, 01 Apr 2012 01:51:38 +1030", us("2012-03-31T15:21:38")), (None, "2020-01-01 00:00:00 UTC", us("2020-01-01T00:00:00")), (None, "2020-01-01T00:00:00Z", us("2020-01-01T00:00:00")),
    (None, "2020-01-01T00:00:00.123456z", us("2020-01-01T00:00:00.123456")), (None, "2020-01-01 00:00:00 GMT+01:00", us("2019-12-31T23:00:00")), (None, "2020-01-01 00:00:00 UTC-5", us("2020-01-01T05:00:00")),
    (None, "2020-01-01T00:00:00-0500", us("2020-01-01T05:00:00")), (None, "2020-06-01T00:00:00[Europe/Berlin]", us("2020-05-31T22:00:00")), ("home", "2020-07-01 12:00:00 CEST", us("2020-07-01T10:00:00")),
    ("usa", "2020-07-01 12:00:00 EST", us("2020-07-01T17:00:00")), ("howe", "2020-01-01 12:00:00 LHDT", us("2020-01-01T01:00:00")), ("tokyo", "20200101_090000", us("2020-01-01T00:00:00")),
    (None, "20200101T090000Z", us("2020-01-01T09:00:00")), ("tokyo", "2020/01/01 9:00 AM", us("2020-01-01T00:00:00")), ("tokyo", "2020-01-01 09:00", us("2020-01-01T00:00:00")),
    (None, "1577836800", us("2020-01-01T00:00:00")), (None, "1577836800.125", us("2020-01-01T00:00:00.125")), (None, " 1577836800000 ", us("2020-01-01T00:00:00")), (None, "1577836800000001", us("2020-01-01T00:00:00.000001")),
    (None, "132223104000000019", us("2020-01-01T00:00:00.000001")), ("home", "2020-10-25 02:30:00", us("2020-10-25T00:30:00")), ("home", "2020-03-29 02:30:00", us("2020-03-29T01:30:00")),
    ("howe", "2020-04-05 01:45:00", us("2020-04-04T14:45:00")),
]
NONE = [
    ("home", x) for x in ("", " ", "-", "::", "N/A", "null", "before 2015", "0000:00:00 00:00:00", "2020:05:17 25:61:00", "2021:13:05 10:00:00", "2023-02-30 11:20:00", "2020-01-01", "12:00:00", "2020-01-01 12:00:60",
                          "01/13/2020 10:00:00", "2020-01-01 13:00 PM", "2020-01-01T00:00:00+19:00", "2020-01-01T00:00:00[No/Where]", "2020-01-01 00:00:00 XYZ", "x2020-01-01T00:00:00", "9" * 25)
] + [(None, "2020-01-01T00:00:00"), ("nowhere", "2020-01-01T00:00:00"), ("bad", "2020-01-01T00:00:00"), (None, "2020-07-01 12:00:00 CEST"), ("home", None)]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "source_label string, time_zone string, date_order string")


def test_readings(spark, sources):
    rows = [(i, *c[:2], "kept") for i, c in enumerate(CASES + NONE)]
    got = readings(spark.createDataFrame(rows, "v int, source_label string, value string, zone string"), sources).collect()
    assert got[0].asDict().keys() == {"v", "source_label", "value", "zone", "readings"}
    for r in got:
        if r.v < len(CASES):
            sure = [x.epoch_us for x in r.readings if x.cost < UNDECLARED]
            assert sure == [CASES[r.v][2]], CASES[r.v]
        else:
            assert r.readings == [], NONE[r.v - len(CASES)]


def test_both_orders_where_none_is_declared(spark, sources):
    got = readings(spark.createDataFrame([("open", "03/04/2020 00:00:00"), ("open", "25/04/2020 00:00:00"), ("open", "04/04/2020 00:00:00")], "source_label string, value string"), sources).collect()
    assert [len(r.readings) for r in got] == [2, 1, 1]


def brute_path(epoch, kind, cost):
    best = None
    for path in itertools.product(*[[j for j in range(2) if kind[i][j] >= 0] for i in range(len(epoch))]):
        c = sum(cost[i][j] for i, j in enumerate(path))
        for i in range(1, len(path)):
            a, b = path[i - 1], path[i]
            c += SWITCH * (kind[i - 1][a] != kind[i][b]) + BACKWARD * (epoch[i][b] < epoch[i - 1][a])
        best = c if best is None else min(best, c)
    return best


def random_stream(rng, n):
    epoch = np.array([[rng.randrange(20), rng.randrange(20)] for _ in range(n)])
    kind = np.array([[3, 4] if rng.random() < 0.7 else [rng.randrange(3), -1] for _ in range(n)])
    cost = np.array([[rng.choice([0.0, 0.5]), rng.choice([0.0, 2.0])] for _ in range(n)])
    return epoch, kind, cost


def path_cost(epoch, kind, cost, path):
    c = cost[np.arange(len(path)), path].sum()
    for i in range(1, len(path)):
        a, b = path[i - 1], path[i]
        c += SWITCH * (kind[i - 1][a] != kind[i][b]) + BACKWARD * (epoch[i][b] < epoch[i - 1][a])
    return c


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_finds_the_cheapest_path(seed):
    e, k, c = random_stream(random.Random(seed), 9)
    assert path_cost(e, k, c, viterbi(e, k, c)) == pytest.approx(brute_path(e, k, c))


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 3), (3, 8), (4, 20)])
def test_streams_over_many_partitions(spark, seed, parts):
    rng = random.Random(seed)
    rows, streams = [], {}
    for s in range(3):
        e, k, c = random_stream(rng, [60, 12, 1][s])
        streams[s] = e, k, c
        for i in range(len(e)):
            r = [(int(e[i][j]), int(k[i][j]), float(c[i][j])) for j in range(2) if k[i][j] >= 0]
            rows.append((s, i, r))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        frame = spark.createDataFrame(rows, "s int, i long, readings array<struct<epoch_us:bigint,notation:int,cost:double>>").repartition(4)
        got = choose_readings(frame, ["s"], "i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows)
    for s, (e, k, c) in streams.items():
        chosen = {r.i: r.epoch_us for r in got if r.s == s}
        n = len(e)
        # Readings are told by their instants; where both are equal either will do.
        options = [[j for j in range(2) if k[i][j] >= 0 and e[i][j] == chosen[i]] for i in range(n)]
        best = [np.inf, np.inf]
        for i in range(n):
            now = [np.inf, np.inf]
            for j in options[i]:
                before = min((best[a] + SWITCH * (k[i - 1][a] != k[i][j]) + BACKWARD * (e[i][j] < e[i - 1][a]) for a in range(2)), default=0) if i else 0
                now[j] = before + c[i][j]
            best = now
        assert min(best) == pytest.approx(path_cost(e, k, c, viterbi(e, k, c)))


def test_order_of_the_stream_decides(spark, sources):
    days = [("open", i, f"{d:02}/06/2020 12:00:00") for i, d in enumerate([1, 2, 3, 13, 14, 15])]
    r = readings(spark.createDataFrame(days, "source_label string, i long, value string"), sources)
    got = {x.i: x.epoch_us for x in choose_readings(r.withColumn("extra", F.lit(1)), ["source_label"], "i").collect()}
    assert got == {i: us(f"2020-06-{d:02}T12:00:00") for i, d in enumerate([1, 2, 3, 13, 14, 15])}


def test_long_paths_equal_a_plain_pass():
    rng = random.Random(5)
    e, k, c = random_stream(rng, 3000)
    best, back = np.where(k[0] < 0, np.inf, c[0]), []
    for i in range(1, len(e)):
        step = np.array([[np.inf if k[i - 1][a] < 0 or k[i][b] < 0 else SWITCH * (k[i - 1][a] != k[i][b]) + BACKWARD * (e[i][b] < e[i - 1][a]) for b in range(2)] for a in range(2)])
        back.append((best[:, None] + step).argmin(0))
        best = (best[:, None] + step).min(0) + np.where(k[i] < 0, np.inf, c[i])
    path = [int(best.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert viterbi(e, k, c).tolist() == path[::-1]
    assert _through(e, k, c).min() == pytest.approx(best.min())


def test_labels_of_one_source_are_one_stream(spark, sources):
    rows = [(1, "a", "03/25/2020 10:00:00 +00:00"), (2, "A ", "04/05/2020 10:00:00 +00:00"), (3, "a", "06/26/2020 10:00:00 +00:00")]
    m = spark.createDataFrame([(i, s, d, None, None) for i, s, d in rows], MAN)
    none = spark.createDataFrame([], "sidecar_id long, source_label string, raw string")
    got = {r.rec_id: r.epoch_us for r in manifest_instants(m, none, sources).collect()}
    assert got[2] == us("2020-04-05T10:00:00")


def test_order_is_seen_across_other_notations(spark, sources):
    rows = [(1, "13/02/2020 10:00:00 +00:00"), (2, "2020-02-14T10:00:00Z"), (3, "04/03/2020 10:00:00 +00:00"), (4, "2020-01-14T10:00:00Z"), (5, "25/03/2020 10:00:00 +00:00")]
    m = spark.createDataFrame([(i, "nobody", d, None, None) for i, d in rows], MAN)
    none = spark.createDataFrame([], "sidecar_id long, source_label string, raw string")
    got = {r.rec_id: r.epoch_us for r in manifest_instants(m, none, sources).collect()}
    assert got[3] == us("2020-03-04T10:00:00") and len(got) == 5


def test_repeated_undecided_rows_come_out_once_each(spark, sources):
    m = spark.createDataFrame([(7, "nobody", "04/05/2020 10:00:00 +00:00", None, None)] * 2 + [(7, "nobody", "05/04/2020 10:00:00 +00:00", None, None)], MAN)
    none = spark.createDataFrame([], "sidecar_id long, source_label string, raw string")
    assert manifest_instants(m, none, sources).count() == 3


def test_sidecar_json(spark):
    texts = {
        '{"photoTakenTime":{"timestamp":"5"}}': "5", '{"photoTakenTime":{"timestamp":5}}': "5", '{"photoTakenTime":{"timestamp":"5"}': None, '{"photoTakenTime":{"timestamp":"5"}} x': None, "[]": None, "null": None, "": None,
        "<html>": None, '{"photoTakenTime":{}}': None, '{"photoTakenTime":"5"}': None, '{"description":"\\"photoTakenTime\\"","photoTakenTime":{"formatted":"a","timestamp":"7"}}': "7", '{"a":1},{"b":2}': None,
    }
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "raw string").select("raw", sidecar_time(F.col("raw")).alias("t")).collect()
    assert {r.raw: r.t for r in rows} == texts | {None: None}


MAN = "id long, source_label string, shot_date string, creation_date string, mtime string"


def test_whole(spark, sources):
    m = spark.createDataFrame([(1, "home", "2020-07-01T12:00:00", None, "1577836800"), (2, None, "2020-07-01T12:00:00", "-", "")], MAN)
    s = spark.createDataFrame([(1, None, '{"photoTakenTime":{"timestamp":"1577836800"}}'), (2, None, None)], "sidecar_id long, source_label string, raw string")
    got = {tuple(r) for r in manifest_instants(m, s, sources).collect()}
    assert got == {(1, "shot_date", us("2020-07-01T10:00:00")), (1, "mtime", us("2020-01-01T00:00:00")), (1, "photo_taken", us("2020-01-01T00:00:00"))}
    none = lambda x: spark.createDataFrame([], x.schema)
    assert manifest_instants(none(m), none(s), sources).collect() == []
    assert manifest_instants(none(m), s, none(sources)).count() == 1


def test_abbreviations():
    got = {(z, a): s for z, a, s in zone_abbreviations(["Europe/London", "Asia/Kolkata", "Asia/Kathmandu", "No/Where"])}
    assert got["Europe/London", "bst"] == 3600 and got["Asia/Kolkata", "ist"] == 19800 and got["Asia/Kathmandu", "npt"] == 20700
