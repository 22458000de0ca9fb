import random

import numpy as np
import pytest

from kinfold.llm.graph import build, search
from kinfold.llm.nearest import nearest_pairs

SCHEMA = "id long, phash string"


def brute(rows, k=5, radius=7):
    own = [(i, int(p, 16)) for i, p in rows if p and len(p) == 16 and 4 <= int(p, 16).bit_count() <= 60]
    out = set()
    for i, p in own:
        near = sorted(((p ^ q).bit_count(), j) for j, q in own if j != i and (p ^ q).bit_count() <= radius)
        out |= {(min(i, j), max(i, j)) for _, j in near[:k]}
    return out


def clustered(seed, clusters, size):
    rng = random.Random(seed)
    out = []
    for _ in range(clusters):
        c = rng.getrandbits(64)
        for _ in range(rng.randrange(1, size)):
            h = c
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                h ^= 1 << b
            out.append(f"{h:016x}")
    return list(enumerate(out, 1))


@pytest.mark.parametrize("seed", range(2))
def test_small_sets_are_exact(spark, seed):
    rows = clustered(seed, 25, 14)
    assert {tuple(r) for r in nearest_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_shards_are_merged(spark):
    rows = clustered(5, 60, 10)
    got = {tuple(r) for r in nearest_pairs(spark.createDataFrame(rows, SCHEMA), shard_rows=60).collect()}
    want = brute(rows)
    assert got == want


def test_many_shards_and_a_crowd(spark):
    # Some 80 shards; a crowd whose cells are cut and whose visits come in chunks.
    rows = clustered(6, 400, 10)
    centre = random.Random(1).getrandbits(64)
    for i in range(600):
        h = centre
        for b in random.Random(i).sample(range(64), 5):
            h ^= 1 << b
        rows.append((10_000 + i, f"{h:016x}"))
    got = {tuple(r) for r in nearest_pairs(spark.createDataFrame(rows, SCHEMA), shard_rows=40, chunk_rows=300).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_all_cells_visited_is_exact(spark):
    rows = clustered(6, 80, 10)
    got = {tuple(r) for r in nearest_pairs(spark.createDataFrame(rows, SCHEMA), shard_rows=20, visits=1000).collect()}
    assert got == brute(rows)


def test_recall_of_the_graph():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 1500).astype(np.uint64)
    values = np.unique(np.concatenate([centres, *[centres ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) for _ in range(4)]]))
    g = build(values)
    hit = total = 0
    for lo in range(0, len(values), 1000):
        keys = search(g, values[lo : lo + 1000], 32)[:, :6]
        apart = np.bitwise_count(values[lo : lo + 1000][:, None] ^ values[None, :])
        for row, d in zip(keys, apart, strict=True):
            true = np.lexsort((np.arange(len(values)), d))[:6]
            want = {int(x) for x in true if d[x] <= 7}
            hit += len(want & {(int(k) & ((1 << 40) - 1)) >> 1 for k in row})
            total += len(want)
    assert hit / total >= 0.98


def test_nearest_of_a_crowd_are_linked():
    # All arrive with more close ones than have a place: the nearest must be kept.
    rng = np.random.default_rng(8)
    values = np.full(4096, 0x9E3779B97F4A7C15, np.uint64)
    for _ in range(8):
        values ^= np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64)
    values = rng.permutation(np.unique(values))
    links = build(values).layers[0].neighbours
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    np.fill_diagonal(apart, 99)
    held = np.where(links >= 0, np.take_along_axis(apart, np.maximum(links, 0).astype(np.int64), 1), 99)
    assert (held.min(1) == apart.min(1)).mean() >= 0.95


def test_equal_hashes_and_edges(spark):
    h = "f0f0f0f0f0f0f0f0"
    rows = [(i, h) for i in range(1, 30)] + [(50, None), (51, ""), (52, "zz"), (53, "0" * 16), (54, "f" * 16), (55, "0f0f0f0f0f0f0f0f")]
    frame = spark.createDataFrame([(*r, 0, "m") for r in rows], SCHEMA + ", a int, mid string")
    assert {tuple(r) for r in nearest_pairs(frame).collect()} == brute([r for r in rows if r[1] != "zz"])
    assert nearest_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert nearest_pairs(spark.createDataFrame([(1, h)], SCHEMA)).collect() == []


def test_writings_of_a_hash(spark):
    got = nearest_pairs(spark.createDataFrame([(1, " 0xF0F0F0F0F0F0F0F0"), (2, "f0f0f0f0f0f0f0f0")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 2)]
