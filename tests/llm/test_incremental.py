import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from kinfold.llm.incremental import History, admit, close_pairs, found_repeats, pivot_table, probes, thresholds
from kinfold.runtime import Scratch

HIST = "id long, source_hash string, phash string"


def digest(n):
    return f"{n:064x}"


def brute(history, incoming, radius=6):
    """Row by row, as the problem states it."""
    seen, out = list(history), []
    for i, dg, ph in sorted(incoming):
        same = [a for a, d, _ in seen if dg is not None and d == dg]
        near = [((ph ^ p) .bit_count(), a) for a, _, p in seen if ph is not None and p is not None and (ph ^ p).bit_count() <= radius]
        if same:
            out.append((min(same), i))
        elif near:
            out.append((min(near)[1], i))
        else:
            seen.append((i, dg, ph))
    return sorted(out)


def rows(data):
    return [(i, None if d is None else digest(d), None if p is None else f"{p:016x}") for i, d, p in data]


def flip(rng, h, n):
    for b in rng.sample(range(64), n):
        h ^= 1 << b
    return h


@pytest.mark.parametrize("seed", range(4))
def test_same_as_row_by_row(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]

    def row(i):
        ph = None if rng.random() < 0.1 else flip(rng, rng.choice(centres), rng.randrange(0, 8))
        if ph is not None and not 4 <= ph.bit_count() <= 60:
            ph = None
        return i, None if rng.random() < 0.2 else rng.randrange(40), ph

    history, incoming = [row(i) for i in range(40)], [row(1000 + i) for i in range(120)]
    got = found_repeats(spark.createDataFrame(rows(history), HIST), spark.createDataFrame(rows(incoming), HIST))
    assert sorted(map(tuple, got.collect())) == brute(history, incoming)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6, 7])
def test_no_pair_within_the_radius_is_missed(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(63) for _ in range(40)]
    others = [flip(rng, b, n) & (2**63 - 1) for b in base for n in range(0, radius + 3)]
    table = pivot_table(spark.createDataFrame([(h,) for h in set(others)], "h long"), radius)
    got = {(r.q, r.h) for r in close_pairs(spark.createDataFrame([(b,) for b in base], "q long"), table, radius).collect()}
    assert got == {(a, b) for a in base for b in set(others) if (a ^ b).bit_count() <= radius}
    assert sum(t + 1 for t in thresholds(radius)) == radius + 1


def test_batch_by_batch_equals_all_at_once(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(4)]
    data = [(i, rng.randrange(30), flip(rng, rng.choice(centres), rng.randrange(0, 6))) for i in range(90)]
    schema = "id long, dg string, ph long"
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = lambda part: spark.createDataFrame([(i, digest(d), signed(p)) for i, d, p in part], schema)
    history = History(spark, f"{Scratch(spark, 'test').root}/h")
    history.append(frame(data[:30]))
    found = []
    for part in (data[30:50], data[50:90]):
        out = admit(frame(part), history).collect()
        found += [(r.accepted_id, r.id) for r in out if r.accepted_id is not None]
        assert sorted(r.id for r in out) == sorted(i for i, _, _ in part)
        new = {r.id for r in out if r.accepted_id is None}
        history.append(frame([x for x in part if x[0] in new]))
    assert sorted(found) == brute(data[:30], data[30:])
    whole = history.compact(f"{Scratch(spark, 'test').root}/h")
    assert {(r.h, r.id, r.k) for r in whole.pivots().collect()} == {(r.h, r.id, r.k) for r in history.pivots().collect()}
    assert {(r.dg, r.id) for r in whole.digests().collect()} == {(r.dg, r.id) for r in history.digests().collect()}


def test_chains_need_no_limit(spark):
    # Each row is close to the one before only: in rounds alone, half as many as there are rows.
    h, chain = 0x0F0F0F0F0F0F0F0F, []
    bits = [b for b in range(64)]
    for i in range(60):
        chain.append((100 + i, None, h))
        for b in bits[(i * 5) % 60 : (i * 5) % 60 + 5]:
            h ^= 1 << b
    incoming = spark.createDataFrame(rows(chain), HIST)
    got = sorted(map(tuple, found_repeats(spark.createDataFrame([], HIST), incoming).collect()))
    assert got == brute([], chain)
    history = History(spark, f"{Scratch(spark, 'test').root}/h")
    history.append(spark.createDataFrame([], "id long, dg string, ph long"))
    signed = spark.createDataFrame([(i, None, p - (1 << 64) if p >> 63 else p) for i, _, p in chain], "id long, dg string, ph long")
    small = admit(signed, history, piece_rows=7, rounds=1).where("accepted_id is not null").select("accepted_id", "id").collect()
    assert sorted(map(tuple, small)) == got


def test_batches_in_turn(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(5)]
    data = [(i, rng.randrange(60) if rng.random() < 0.5 else None, flip(rng, rng.choice(centres), rng.randrange(0, 8))) for i in range(120)]
    named = [(*r, None if r[0] % 17 == 0 else (r[0] - 40) // 20) for r in rows(data[40:])]
    got = found_repeats(spark.createDataFrame(rows(data[:40]), HIST), spark.createDataFrame(named, HIST + ", batch_no int"))
    assert sorted(map(tuple, got.collect())) == brute(data[:40], data[40:])
    mixed = [(*r, r[0] % 3) for r in rows(data[40:])]
    again = found_repeats(spark.createDataFrame(rows(data[:40]), HIST), spark.createDataFrame(mixed, HIST + ", batch_no int"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_what_a_batch_reads_does_not_grow_with_the_history(spark):
    rng = np.random.default_rng(0)
    new = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63, 2)], "q long")
    read, files = [], []
    for size in (4_000, 16_000):
        h = rng.integers(-(2**63), 2**63, size)
        old = spark.createDataFrame([(i, f"{x & (2**64 - 1):016x}" + "0" * 48, x) for i, x in enumerate(h.tolist())], "id long, dg string, ph long")
        history = History(spark, f"{Scratch(spark, 'test').root}/h", cell_rows=200)
        history.append(old)
        assert history.cells == size // 200
        near = history.pivots(probes(new, 6))
        read.append(near.count())
        files.append(near.select(F.input_file_name()).distinct().count())
        assert history.digests(old.limit(3).select("dg")).count() <= 3 * 400
    # Two hashes reach 52 cells each at most, of some 200 rows, however many cells there are.
    assert max(files) <= 2 * 52 and read[1] < 1.6 * read[0] and read[1] < 0.5 * 4 * 16_000


def test_bands_meet_a_thousandth(spark):
    rng = np.random.default_rng(1)
    h = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63, 20_000)], "h long")
    q = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63, 200)], "q long")
    assert probes(q, 6).join(pivot_table(h, 6), "k").count() < 0.0015 * 20_000 * 200


def test_edge_rows(spark):
    history = [(1, "SHA256:" + "A" * 64, "0xF0F0f0f0F0F0F0F0 "), (2, None, None), (3, "", "zz"), (4, "abc", "0000000000000000")]
    incoming = [(10, " " + "a" * 64 + " ", None), (11, None, "f0f0f0f0f0f0f0f1"), (12, None, None), (13, "", ""), (14, "abc", "0000000000000000"), (15, None, "F0F0F0F0F0F0F0F1"), (16, None, None)]
    extra = spark.createDataFrame([(*r, 1, "x") for r in incoming], HIST + ", k int, h string")
    got = found_repeats(spark.createDataFrame(history, HIST), extra)
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (1, 15)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], HIST)
    some = spark.createDataFrame(rows([(1, 1, 0xF0F0F0F0F0F0F0F0), (2, 1, None)]), HIST)
    assert found_repeats(some, none).collect() == []
    assert [tuple(r) for r in found_repeats(none, some).collect()] == [(1, 2)]
    assert found_repeats(none, none).collect() == []


def test_the_driver_lets_go_of_each_batch(spark, monkeypatch):
    settled, settle = [], Scratch.settle
    monkeypatch.setattr(Scratch, "settle", lambda self: settled.append(self) or settle(self))
    frame = spark.createDataFrame([(i, i // 10, digest(i % 25), None) for i in range(30)], "id long, batch_no int, source_hash string, phash string")
    assert sorted(map(tuple, found_repeats(frame.where("false"), frame).collect())) == [(i - 25, i) for i in range(25, 30)]
    assert len(settled) == 3
