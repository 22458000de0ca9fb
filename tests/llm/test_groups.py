import math
import random

import pytest

from kinfold.llm.components import connected_groups
from kinfold.llm.survivor import best_of_group, merged_survivor
from kinfold.llm.topn import top_n_per_group
from pyspark.sql import functions as F

LINK = "source_path string, duplicate_of string"


def union_find(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a and b and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(f"/p{rng.randrange(80)}", f"/p{rng.randrange(80)}") for _ in range(60)] + [(None, "/a"), ("/a", ""), ("/b", "/b"), ("", "")]
    links += [(b, a) for a, b in links[:10]] + links[:5]
    got = connected_groups(spark.createDataFrame(links, LINK))
    assert dict(map(tuple, got.collect())) == union_find(links)


def test_long_chain_and_hub(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = [(f"c{a:04}", f"c{b:04}") for a, b in zip(order, order[1:], strict=False)] + [("hub", f"h{i}") for i in range(300)]
    got = dict(map(tuple, connected_groups(spark.createDataFrame(links, LINK)).collect()))
    assert got == union_find(links)


def test_no_links(spark):
    assert connected_groups(spark.createDataFrame([], LINK)).collect() == []
    assert connected_groups(spark.createDataFrame([(None, None), ("a", "a")], LINK)).collect() == []


def test_order_is_by_code_point(spark):
    got = connected_groups(spark.createDataFrame([("é", "z"), ("z", "Z"), ("\U0001f600", "～")], LINK))
    assert dict(map(tuple, got.collect())) == {"é": "Z", "z": "Z", "Z": "Z", "\U0001f600": "～", "～": "～"}


MAN = "id long, group_id string, score double, exif_tag_count int, gps_present int, file_size_bytes long"


def random_rows(seed, n=400, groups=12):
    rng = random.Random(seed)
    some = lambda *x: rng.choice([None, *x])
    return [
        (i, rng.choice([None, "", *(f"g{min(rng.randrange(groups), rng.randrange(groups))}" for _ in range(3))]), some(0.5, 0.7, math.nan, -1.0, 2.0, 1.0, 0.0), some(-1, 0, 3), some(0, 1), some(-1, 0, 5, 9))
        for i in range(n)
    ]


def score(x):
    return x if x is not None and not math.isnan(x) and 0 <= x <= 1 else None


def last(x):
    return (x is None, -(x or 0))


@pytest.mark.parametrize("seed", range(3))
def test_best_of_group(spark, seed):
    data = random_rows(seed)
    want = {}
    for g in {r[1] for r in data if r[1]}:
        own = [r for r in data if r[1] == g]
        if len(own) > 1:
            key = lambda r: (last(score(r[2])), last(r[3] if r[3] is not None and r[3] >= 0 else None), last(r[4]), last(r[5] if r[5] is not None and r[5] >= 1 else None), r[0])
            want[g] = min(own, key=key)[0]
    got = best_of_group(spark.createDataFrame(data, MAN).repartition(7).withColumn("k", F.lit(1)))
    assert dict(map(tuple, got.collect())) == want


def test_best_of_group_edges(spark):
    frame = lambda d: spark.createDataFrame(d, MAN)
    assert best_of_group(frame([])).collect() == []
    assert best_of_group(frame([(1, "a", None, None, None, None)])).collect() == []
    assert [tuple(r) for r in best_of_group(frame([(1, "a", None, None, None, None)] * 2)).collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        best_of_group(frame([]), least=0)


def test_the_limit_runs_before_the_shuffle(spark):
    plan = best_of_group(spark.createDataFrame(random_rows(1), MAN))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") < plan.rindex("WindowGroupLimit")


def test_merged_survivor(spark):
    rows = spark.createDataFrame([("g", 1, None, "x"), ("g", 5, "b", None), ("g", 3, "a", "y"), ("", 9, "q", "q")], "g string, t int, a string, b string")
    assert [tuple(r) for r in merged_survivor(rows, "g", ["a", "b"], [F.col("t")]).collect()] == [("g", "b", "y")]


@pytest.mark.parametrize(("seed", "parts", "n"), [(0, 1, 3), (1, 3, 3), (2, 16, 3), (3, 40, 1), (4, 16, 50)])
def test_top_n(spark, seed, parts, n):
    data = random_rows(seed, 500, 4 if seed % 2 else 30)
    want = []
    for g in {r[1] for r in data if r[1]}:
        own = sorted((-score(r[2]), r[0]) for r in data if r[1] == g and score(r[2]) is not None)
        want += [(g, k + 1, i) for k, (_, i) in enumerate(own[:n])]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = top_n_per_group(spark.createDataFrame(data, MAN).repartition(5), n)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_top_n_across_small_batches(spark):
    data = [(i, "g" if i % 3 else "a", 0.5, None, None, None) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, top_n_per_group(spark.createDataFrame(data, MAN), 4).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [("a", k + 1, 3 * k) for k in range(4)] + [("g", k + 1, i) for k, i in enumerate([1, 2, 4, 5])]


def test_top_n_edges(spark):
    frame = lambda d: spark.createDataFrame(d, MAN)
    assert top_n_per_group(frame([]), 3).collect() == []
    assert top_n_per_group(frame([(1, "g", 0.1, None, None, None)]), 0).collect() == []
    got = top_n_per_group(frame([(1, "g", 0.1, None, None, None)] * 2 + [(2, "g", None, None, None, None)]).withColumn("part", F.lit(1)), 3)
    assert sorted(map(tuple, got.collect())) == [("g", 1, 1), ("g", 2, 1)]
