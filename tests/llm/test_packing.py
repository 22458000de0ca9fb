import bisect
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm.packing import _Stock, pack, pack_documents, plan

BUDGET = "budget_id int, name string, capacity_tokens int"


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=200, deadline=None)
def test_plans_use_every_item_once(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    p = plan(counts, 40)
    used = np.zeros(41, int)
    for pattern, times in zip(p.patterns, p.times, strict=True):
        assert times > 0 and sum(n * c for n, c in pattern.items()) <= 40
        for n, c in pattern.items():
            used[n] += c * times
    assert (used == counts).all()


def test_exact_complements_first():
    counts = np.zeros(101, int)
    counts[[60, 40, 70, 10, 20, 55, 25, 15, 5]] = [3, 3, 2, 2, 2, 1, 1, 1, 1]
    p = plan(counts, 100)
    assert all(sum(n * c for n, c in x.items()) == 100 for x in p.patterns)
    assert sum(p.times) == 6


def test_three_that_fill_a_gap_are_found_behind_many_that_do_not():
    # Ten longer lengths each need two of a length of which there is one; no two of all fill the gap.
    single = [1, 3, 7, 9, 19, 21, 25, 27, 55, 57]
    counts = np.zeros(2001, int)
    counts[single + [2000 - 2 * y for y in single] + [700, 657, 643]] = 1
    stock = _Stock(counts)
    assert sorted(stock.exact(2000, stock.left, 3)) == [643, 657, 700]
    assert (stock.left == counts).all()


def test_triples_against_all_combinations():
    rng = random.Random(7)
    for _ in range(300):
        counts = np.zeros(61, int)
        for _ in range(rng.randrange(1, 12)):
            counts[rng.randrange(1, 61)] = rng.randrange(1, 3)
        stock = _Stock(counts)
        for _ in range(6):
            items = [n for n in range(61) for _ in range(stock.left[n])]
            gap = rng.randrange(1, 121)
            there = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(items, k))
            got = stock.exact(gap, stock.left, 3)
            assert (got is not None) == there and (got is None or sum(got) == gap)
            for n in got or rng.sample(items, min(1, len(items))):
                stock.left[n] -= 1


def test_a_length_that_was_lent_out_is_found_again():
    counts = np.zeros(4001, int)
    counts[[691, 866, 2443]] = 1
    stock = _Stock(counts)
    stock.left[2443] -= 1
    assert stock.exact(4000, stock.left, 3, [2443]) is None
    stock.left[2443] += 1
    assert sorted(stock.exact(4000, stock.left, 3)) == [691, 866, 2443]


def test_planning_does_not_grow_with_the_items():
    rng = np.random.default_rng(0)
    counts = np.zeros(1025, int)
    counts[1:] = rng.poisson(3, 1024)
    few, many = plan(counts, 1024), plan(counts * 10_000, 1024)
    assert len(many.patterns) < 3 * len(few.patterns) + 1024


def best_fit_decreasing(counts, capacity):
    free = []
    for x in sorted(np.repeat(np.arange(len(counts)), counts).tolist(), reverse=True):
        i = bisect.bisect_left(free, x)
        bisect.insort(free, (free.pop(i) if i < len(free) else capacity) - x)
    return len(free)


@pytest.mark.parametrize("kind", ["uniform", "middle", "short", "long tail"])
def test_no_more_containers_than_best_fit_decreasing(kind):
    rng = np.random.default_rng(1)
    lengths = {
        "uniform": rng.integers(1, 513, 2000), "middle": rng.integers(100, 300, 2000), "short": rng.integers(10, 30, 5000), "long tail": np.clip(rng.lognormal(4, 1, 3000).astype(int), 1, 512),
    }[kind]
    counts = np.bincount(lengths, minlength=513)
    assert sum(plan(counts, 512).times) <= best_fit_decreasing(counts, 512)


def check(rows, sizes, capacity):
    boxes, slots, pieces = {}, set(), {}
    for r in rows:
        boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
        assert (r.container_id, r.slot) not in slots
        slots.add((r.container_id, r.slot))
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
    assert all(n <= capacity for n in boxes.values())
    for doc, n in sizes.items():
        if n:
            own = sorted(pieces.pop(doc))
            assert [p for p, _, _ in own] == list(range(-(-n // capacity)))
            assert [s for _, s, _ in own] == [i * capacity for i in range(len(own))]
            assert sum(x for _, _, x in own) == n
    assert not pieces
    assert sorted(boxes) == list(range(len(boxes)))
    return len(boxes)


@pytest.mark.parametrize("seed", range(3))
def test_pack(spark, seed):
    rng = random.Random(seed)
    sizes = {i: rng.choice([0, 7, 7, 7, rng.randrange(1, 300), rng.randrange(1, 60)]) for i in range(400)}
    budgets = spark.createDataFrame([(1, "a", 64), (2, "b", 200), (3, "none", None), (4, "zero", 0)], BUDGET)
    frame = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").repartition(6)
    rows = pack(frame, budgets).collect()
    assert {r.budget_id for r in rows} == {1, 2}
    for b, c in ((1, 64), (2, 200)):
        boxes = check([r for r in rows if r.budget_id == b], sizes, c)
        assert boxes <= 1.02 * -(-sum(sizes.values()) // c) + 1


def test_one_length_for_all(spark):
    rows = pack(spark.createDataFrame([(i, 3) for i in range(1000)], "doc_id long, n_tokens long").repartition(5), spark.createDataFrame([(1, "a", 10)], BUDGET)).collect()
    assert check(rows, dict.fromkeys(range(1000), 3), 10) == 334


def test_pack_edges(spark):
    one = spark.createDataFrame([(1, "a", 10)], BUDGET)
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack(none, one).collect() == []
    assert pack(spark.createDataFrame([(1, None), (2, 0)], "doc_id long, n_tokens long"), one).collect() == []
    assert pack(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long"), spark.createDataFrame([], BUDGET)).collect() == []
    assert pack(none, spark.createDataFrame([(1, "a", 1 << 21)], BUDGET)).collect() == []
    twice = pack(spark.createDataFrame([(1, 4), (1, 4)], "doc_id long, n_tokens long"), one).collect()
    assert sorted((r.container_id, r.slot) for r in twice) == [(0, 0), (0, 1)]


def test_texts_of_any_kind(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one small text"), (4, "word " * 5000), (5, "é" * 3000), (6, "<|endoftext|>")], "doc_id long, text string")
    rows = pack_documents(docs, spark.createDataFrame([(1, "a", 256)], BUDGET)).collect()
    assert {r.doc_id for r in rows} == {3, 4, 5, 6}
    assert sum(r.n_tokens for r in rows if r.doc_id == 4) >= 5000
