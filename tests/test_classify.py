import random

import pytest

from kinfold.operators import classify as C
from kinfold.operators.components import components
from kinfold.operators import similarity
from kinfold.operators.similarity import Blocks, best_blocks, hash_value_pairs, similar_pairs
from kinfold.functions.labels import hex_hash
from pyspark.sql import functions as F

MEDIA = "ord long, path string, source_label string, file_type string, sha256 string, phash string, dhash string, mean_color string, pixel_width int, pixel_height int, exif_date timestamp_ntz"


def flip(rng, h, n):
    for b in rng.sample(range(64), n):
        h ^= 1 << b
    return h


def random_media(seed, n):
    """Clusters of nearly equal hashes with colours and second hashes, from three sources."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        centre, colour = rng.getrandbits(64), [rng.randrange(256) for _ in range(3)]
        for _ in range(rng.randrange(1, 7)):
            h = flip(rng, centre, rng.randrange(0, 8))
            rows.append([f"{h:016x}", rng.choice([None, "", f"{flip(rng, centre, rng.randrange(0, 14)):016x}"]), rng.choice([None, "", ",".join(str(min(255, max(0, c + rng.randrange(-20, 21)))) for c in colour)])])
    rng.shuffle(rows)
    return [
        (i, f"/{rng.choice('abc')}/f{i // 2}{rng.choice(['.jpg', '.heic', '.png', '.dng', '.mov'])}", rng.choice(["one", "two", "three"]), None, f"s{rng.randrange(n)}", *r, rng.choice([None, 4000, 100]), 3000, None)
        for i, r in enumerate(rows[:n])
    ]


TYPES = {"jpg": "jpeg", "heic": "heic", "png": "png", "dng": "raw", "mov": "mov"}


def with_type(rows):
    return [(*r[:3], TYPES[r[1].rsplit(".")[-1]], *r[4:]) for r in rows]


def ham(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count() if a and b else None


def vote(a, b):
    d = ham(a, b)
    return "unknown" if d is None else "agree" if d <= 10 else "disagree"


def colour_ok(a, b):
    if not a or not b:
        return True
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a.split(","), b.split(","), strict=True)) ** 0.5 <= 30


def simulate(rows, threshold):
    """The passes as loops over rows in order."""
    prio = {}
    for r in rows:
        prio.setdefault(r[2], len(prio))
    out, edges = {}, []
    groups = {}
    for r in rows:
        groups.setdefault(r[4], []).append(r)
    for g in groups.values():
        g = sorted(g, key=lambda r: (prio[r[2]], r[0]))
        for r in g[1:]:
            out[r[0]] = ("EXACT", g[0][1], None)
            edges.append((r[1], g[0][1]))
    cand = [r for r in rows if r[0] not in out and r[5] and 4 <= int(r[5], 16).bit_count() <= 60 and (r[8] is None or min(r[8], r[9]) >= 128)]
    equal = {}
    for r in cand:
        equal.setdefault(r[5], []).append(r)
    for g in equal.values():
        lossy = sorted((r for r in g if r[3] in C.FORMAT_RANK), key=lambda r: (C.FORMAT_RANK[r[3]], prio[r[2]], r[0]))
        if len(lossy) < 2 or any(r[3] == "raw" for r in g):
            continue
        k = lossy[0]
        for r in lossy[1:]:
            if colour_ok(r[7], k[7]) and vote(r[6], k[6]) != "disagree":
                out[r[0]] = ("EXACT", k[1], 0)
                edges.append((r[1], k[1]))
    left = [r for r in cand if r[0] not in out]
    for x, a in enumerate(left):
        for b in left[x + 1 :]:
            d = ham(a[5], b[5])
            if not 0 < d <= threshold or not colour_ok(a[7], b[7]) or vote(a[6], b[6]) == "disagree":
                continue
            edges.append((a[1], b[1]))
            if b[0] in out:
                continue
            if prio[a[2]] <= prio[b[2]]:
                out[b[0]] = ("REVIEW_DUPLICATE", a[1], d)
            elif a[0] not in out:
                out[a[0]] = ("REVIEW_DUPLICATE", b[1], d)
    for x, a in enumerate(rows):
        for b in rows[x + 1 :]:
            if a[1].rsplit(".")[0] == b[1].rsplit(".")[0] and a[1] != b[1] and (not a[5] or not b[5] or ham(a[5], b[5]) <= threshold):
                edges.append((a[1], b[1]))
    return out, edges


def unite(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def unique_paths(rows):
    seen = set()
    return [r for r in rows if not (r[1] in seen or seen.add(r[1]))]


@pytest.mark.parametrize(("seed", "threshold"), [(7, 10), (42, 3), (11, 12)])
def test_same_as_loops(spark, seed, threshold):
    rows = unique_paths(with_type(random_media(seed, 120)))
    frame = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), MEDIA)
    got = C.classify(frame, C.Thresholds(hamming=threshold)).collect()
    want, edges = simulate(rows, threshold)
    assert {r.ord: (r.action, r.duplicate_of, r.hamming_distance) for r in got if r.duplicate_of} == want
    assert {r.path: r.group_id for r in got if r.group_id} == unite(edges)
    assert {r.action for r in got if not r.duplicate_of} <= {"UNDATED", ""}
    assert len(got) == len(rows)


@pytest.mark.parametrize("radius", [0, 1, 4, 7, 10, 12, 20, 40])
def test_index_equals_brute_force(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(63) for _ in range(12)]
    values = {flip(rng, rng.choice(centres), rng.randrange(0, 9)) & (2**63 - 1) for _ in range(90)}
    frame = spark.createDataFrame([(v,) for v in values], "h long")
    a, b = (sorted(map(tuple, hash_value_pairs(frame, radius, s).collect())) for s in ("index", "brute"))
    assert a == b and len(a) == len({x[:2] for x in a})


@pytest.mark.parametrize("count", [2, 3, 4, 5, 6, 8])
def test_every_cut_of_the_words_finds_all_pairs(spark, count, monkeypatch):
    rng = random.Random(count)
    base = [rng.getrandbits(64) for _ in range(15)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = {signed(flip(rng, h, n)) for h in base for n in range(0, 6)}
    frame = spark.createDataFrame([(v,) for v in values], "h long")
    want = sorted(map(tuple, hash_value_pairs(frame, 4, "brute").collect()))
    monkeypatch.setattr(similarity, "best_blocks", lambda rows, radius: Blocks.of(count, radius))
    assert sorted(map(tuple, hash_value_pairs(frame, 4).collect())) == want


def test_blocks():
    for n in (2, 3, 4, 5, 6, 8):
        for r in range(65):
            b = Blocks.of(n, r)
            assert sum(t + 1 for t in b.budgets) == r + 1 and sum(w for _, w in b.words) == 64
    # More hashes, wider words: the share of pairs that meet shrinks.
    assert len(best_blocks(10**3, 10).words) > len(best_blocks(10**7, 10).words)
    with pytest.raises(ValueError):
        best_blocks(10, 65)


def test_rows_of_equal_hashes_never_meet(spark):
    rows = spark.createDataFrame([(i, "f0f0f0f0f0f0f0f0") for i in range(5)] + [(9, "f0f0f0f0f0f0f0f1"), (10, None)], "ord long, phash string")
    got = similar_pairs(rows, 3, hex_hash(F.col("phash")))
    assert sorted(map(tuple, got.collect())) == [(i, 9, 1) for i in range(5)]


@pytest.mark.parametrize("seed", range(3))
def test_classes_give_what_pairs_give(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(3)]
    rows = [
        (i, f"p{i:03}", rng.randrange(3), f"{flip(rng, rng.choice(base), rng.choice([0, 0, 3, 6])):016x}", rng.choice([None, "1,1,1", "90,1,1"]), rng.choice([None, "f0f0f0f0f0f0f0f0", "0f0f0f0f0f0f0f0f"])) for i in range(80)
    ]
    frame = spark.createDataFrame(rows, "ord long, path string, prio int, phash string, mean_color string, dhash string")
    pairs = C.near_pairs(frame, C.Thresholds())
    members, links = C.near_classes(frame, C.Thresholds())
    assert sorted(map(tuple, C.near_copies_of_classes(members, links).collect())) == sorted(map(tuple, C.near_copies(pairs).collect()))
    edges = [(r.src, r.dst) for r in C.near_edges(members, links).collect()]
    assert unite(edges) == unite([(r.path_i, r.path_j) for r in pairs.collect()])


def test_two_close_hot_hashes(spark):
    n = 3000
    rows = spark.range(2 * n).select(
        F.col("id").alias("ord"), F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"), F.lit(0).alias("prio"),
        F.when(F.col("id") % 2 == 0, "f0f0f0f0f0f0f0f0").otherwise("f0f0f0f0f0f0f0f1").alias("phash"), F.lit(None).cast("string").alias("mean_color"), F.lit(None).cast("string").alias("dhash"),
    )
    members, links = C.near_classes(rows, C.Thresholds())
    assert members.count() == 2 * n and links.count() == 2 and C.near_edges(members, links).count() <= 2 * n + 2
    got = {r.ord: r.keeper for r in C.near_copies_of_classes(members, links).collect()}
    assert got == {i: "p000000" for i in range(1, 2 * n, 2)} | {i: "p000001" for i in range(2, 2 * n, 2)}


def test_gates(spark):
    f = lambda p: spark.range(1).select(C.entropy_ok(F.lit(p), 4)).first()[0]
    assert [f(p) for p in ("0" * 16, "f" * 16, "zz", "000000000000000f", "f0")] == [False, False, True, True, True]
    s = lambda w, h: spark.range(1).select(C.side_ok(F.lit(w).cast("int"), F.lit(h).cast("int"), 128)).first()[0]
    assert [s(128, 128), s(127, 500), s(None, 5)] == [True, False, True]


def test_raw_beside_lossy_is_left_alone(spark):
    row = lambda i, t: (i, f"/x/{i}.{t}", "a", TYPES[t], f"s{i}", "f0f0f0f0f0f0f0f0", None, None, 4000, 3000, None)
    got = C.classify(spark.createDataFrame([row(0, "dng"), row(1, "jpg"), row(2, "heic")], MEDIA)).collect()
    assert all(r.duplicate_of is None and r.group_id is None for r in got)
    got = C.classify(spark.createDataFrame([row(1, "jpg"), row(2, "heic")], MEDIA)).collect()
    assert [(r.ord, r.duplicate_of, r.reason) for r in got if r.duplicate_of] == [(1, "/x/2.heic", "format duplicate of 2.heic (jpeg vs heic)")]


def test_given_priority_and_empty(spark):
    row = lambda i, s: (i, f"/{s}/{i}.jpg", s, "jpeg", "same", None, None, None, None, None, None)
    frame = spark.createDataFrame([row(0, "a"), row(1, "b"), row(2, "other")], MEDIA)
    got = {r.ord: r.duplicate_of for r in C.classify(frame, priority={"b": 0, "a": 1}).collect()}
    assert got == {0: "/b/1.jpg", 1: None, 2: "/b/1.jpg"}
    assert C.classify(spark.createDataFrame([], MEDIA)).collect() == []


def test_stem_pairs(spark):
    paths = ["/d/IMG_1.heic", "/d/IMG_1.mov", "/d/IMG_1(1).mov", "/e/IMG_1.mov", "/d/img_1.mov", "/d/IMG_2-edited.jpg", "/d/IMG_2.jpg", "/d/A(1).jpg", "/d/A(1).mov"]
    frame = spark.createDataFrame([(p, None) for p in paths], "path string, phash string")
    assert sorted(map(tuple, C.stem_pairs(frame, C.Thresholds()).collect())) == [("/d/A(1).jpg", "/d/A(1).mov"), ("/d/IMG_1.heic", "/d/IMG_1.mov")]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = list(range(150))
    rng.shuffle(chain)
    edges = [(f"c{a:03}", f"c{b:03}") for a, b in zip(chain, chain[1:], strict=False)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)] + [(None, "x"), ("y", "y")]
    got = components(spark.createDataFrame(edges, "src string, dst string"))
    assert dict(map(tuple, got.collect())) == unite([e for e in edges if None not in e])
    assert components(spark.createDataFrame([], "src string, dst string")).collect() == []
