"""Problem 8: passages of held-out test items inside corpus texts.

A leak is a stretch of a text that can be made a run of `words` consecutive words of an item's passage by at
most `edits` changes of a character. By the q-gram lemma such a stretch shares at least n - q + 1 - q * edits of
the q-grams of a run of n characters, all on diagonals (place in the text less place in the passage) that lie
within `edits` of each other. Shared q-grams are counted in diagonal bands that overlap by half, bands below
the bound are left, and the rest is settled by alignment within the band.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .canon import any_in, character_map, composed, unstable
from .codepoints import ASSIGNED, CodeTable, code_points, gram_codes, picked, pieces, replaced, strings

#: q-grams of this length, or as many characters as leave one q-gram of the shortest run whole after all edits.
Q = 16
#: q-grams kept of each run besides those that edits can destroy.
SPARE = 8
#: Half the width of a diagonal band.
HALF = 32


@lru_cache(maxsize=1)
def _folded() -> dict[int, str]:
    """Letters and digits to lower case, with one small sigma; all else to a space."""
    out = {}
    for cp in ASSIGNED:
        c = chr(cp)
        kind = unicodedata.category(c)
        low = c.lower().replace("ς", "σ") if kind[0] == "L" or kind == "Nd" else " "
        if low != c:
            out[cp] = low
    return out


def word_tables() -> tuple[CodeTable, CodeTable, CodeTable, np.ndarray]:
    """The one form and the folding in one step, each by itself, and what needs them apart."""
    fold, form = _folded(), character_map()
    both = fold | {cp: "".join(fold.get(ord(c), c) for c in text) for cp, text in form.items()}
    return CodeTable.of(both), CodeTable.of(form), CodeTable.of(fold), unstable()


def worded(tables, cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text in the one form and lower case, a single space before, between and after them."""
    both, form, fold, loose = tables
    at = np.flatnonzero(any_in(loose[cps], ends))
    out, to = both.apply(cps, ends)
    if len(at):
        apart = composed(*form.apply(*code_points(picked(cps, ends, at))), np.ones(len(at), bool))
        out, to = replaced(out, to, at, picked(*fold.apply(*apart), np.arange(len(at))))
    n = len(to) - 1
    owner = np.repeat(np.arange(n), np.diff(to))
    room = to + 2 * np.arange(n + 1)
    laid = np.full(room[-1], 32, np.uint32)
    laid[np.arange(len(out)) + 2 * owner + 1] = out
    space = laid == 32
    gone = np.zeros(len(laid), bool)
    gone[1:] = space[1:] & space[:-1]
    gone[room[:-1]] = False
    kept = np.concatenate(([0], np.cumsum(~gone, dtype=np.int64)))
    return laid[~gone], kept[room]


def _runs(text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of words of one text in words begins and ends, the spaces around it included."""
    spaces = np.flatnonzero(text == 32)
    return spaces[:-words], spaces[words:] + 1


def _items(tables, words: int):
    """Each passage in words, with the lengths of its shortest and longest run; none of fewer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, cps, ends in pieces(batch.column("t")):
                text, to = worded(tables.value, cps, ends)
                sizes = [(e - s) for s, e in (_runs(text[a:b], words) for a, b in zip(to[:-1], to[1:], strict=True))]
                ok = np.array([len(x) > 0 for x in sizes])
                low, high = ([int(f(x)) for x in sizes if len(x)] for f in (np.min, np.max))
                keys = batch.column("k").slice(lo, hi - lo).filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([keys, strings(text, to).filter(pa.array(ok)), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["k", "t", "low", "high"])

    return run


def _item_grams(q: int):
    """Every q-gram of each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, cps, ends in pieces(batch.column("t")):
                code = gram_codes(cps, q)
                at = np.arange(len(code))
                owner = np.searchsorted(ends, at, "right") - 1
                ok = at + q <= ends[owner + 1]
                at, owner = at[ok], owner[ok]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("n").take(pa.array(lo + owner)), pa.array(at - ends[owner]), pa.array(code[at].view(np.int64))], names=["n", "src", "code"]
                )

    return run


def _rarest(q: int, edits: int, words: int):
    """The q-grams of items that are among the rarest of any of their runs, and how many of them a leak must share."""

    def run(grams, items):
        import pandas as pd

        parts = []
        grams = grams.sort_values(["n", "src"])
        bounds = np.searchsorted(grams["n"], items["n"], "left"), np.searchsorted(grams["n"], items["n"], "right")
        src, code, held = (grams[c].to_numpy() for c in ("src", "code", "held"))
        for key, n, passage, lo, hi in zip(items["k"], items["n"], items["t"], *bounds, strict=True):
            text, _ = code_points([passage])
            order = np.empty(hi - lo, np.int64)
            order[np.lexsort((src[lo:hi], code[lo:hi], held[lo:hi]))] = np.arange(hi - lo)
            keep, need = np.zeros(hi - lo, bool), len(text)
            for s, e in zip(*_runs(text, words), strict=True):
                own = order[s : e - q + 1]
                most = min(len(own), q * edits + SPARE)
                keep[s + np.argpartition(own, most - 1)[:most]] = True
                need = min(need, most - q * edits)
            parts.append(pd.DataFrame({"k": key, "n": n, "src": src[lo:hi][keep], "code": code[lo:hi][keep], "need": need}))
        return pd.concat(parts) if parts else pd.DataFrame({"k": [], "n": [], "src": [], "code": [], "need": []}).astype("int64")

    return run


def _scan(tables, marks, q: int, reach: int, need: int):
    """Stretches of texts that hold enough q-grams of any item, with these q-grams and as much text around as a leak can take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(marks.value).view(bool)
        shift = np.uint64(64 - (len(bits) - 1).bit_length())
        for batch in batches:
            for lo, _, cps, ends in pieces(batch.column("t")):
                text, to = worded(tables.value, cps, ends)
                code = gram_codes(text, q)
                pos = np.flatnonzero(bits[code >> shift])
                doc = np.searchsorted(to, pos, "right") - 1
                ok = pos + q <= to[doc + 1]
                pos, doc = pos[ok], doc[ok]
                # Only q-grams of which there are enough within the length of a leak.
                first = np.flatnonzero((pos[need - 1 :] - pos[: len(pos) - need + 1] <= reach) & (doc[need - 1 :] == doc[: len(pos) - need + 1]))
                if not len(first):
                    continue
                dense = np.zeros(len(pos) + 1, np.int64)
                np.add.at(dense, first, 1)
                np.add.at(dense, first + need, -1)
                ok = np.cumsum(dense[:-1]) > 0
                pos, doc = pos[ok], doc[ok]
                new = np.ones(len(pos), bool)
                new[1:] = (np.diff(pos) > reach) | (np.diff(doc) != 0)
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(pos))
                first, last, owner = pos[head], pos[tail - 1], doc[head]
                begin = np.maximum(to[owner], first - reach)
                end = np.minimum(to[owner + 1], last + q + reach)
                size = tail - head
                at = np.concatenate(([0], np.cumsum(end - begin)))
                index = np.arange(at[-1]) + np.repeat(begin - at[:-1], end - begin)
                lists = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("d").take(pa.array(lo + owner)),
                        strings(text[index], at),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(pos - np.repeat(begin, size))),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(code[pos].view(np.int64))),
                    ],
                    names=["d", "t", "pos", "code"],
                )

    return run


def aligned(runs: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The fewest edits that turn some stretch of each text into each run, on paths within diagonals low to high.

    A diagonal is the place in the text less the place in the run. All pairs advance together, one character of
    the runs a step; a row holds the costs on the diagonals of one pair.
    """
    width, longest, count = int((high - low).max()) + 1, max(map(len, runs)), len(runs)
    far = 1 << 20
    size = np.array([len(r) for r in runs])
    run = np.full((count, longest), 0xFFFFFFFE, np.uint32)
    text = np.full((count, longest + width), 0xFFFFFFFF, np.uint32)
    for i, (r, t) in enumerate(zip(runs, texts, strict=True)):
        run[i, : len(r)] = r
        a = int(low[i])
        part = t[max(a, 0) : max(a + longest + width, 0)]
        text[i, max(-a, 0) : max(-a, 0) + len(part)] = part[: longest + width - max(-a, 0)]
    step = np.arange(width)
    cost = np.where(step[None, :] <= (high - low)[:, None], 0, far)
    best = np.full(count, far)
    for i in range(longest):
        through = cost + (text[:, i : i + width] != run[:, i, None])
        through[:, :-1] = np.minimum(through[:, :-1], cost[:, 1:] + 1)
        through[step[None, :] > (high - low)[:, None]] = far
        cost = np.minimum.accumulate(through - step, axis=1) + step
        done = size == i + 1
        best[done] = cost[done].min(1)
    return best


def _verify(q: int, edits: int, words: int):
    """The pairs of a stretch of text and an item whose band holds a leak."""

    def candidates(text: np.ndarray, passage: np.ndarray, bands: list[int]) -> list[tuple]:
        """(bound missed by, run from, run to, lowest and highest diagonal) of the runs that reach the bound on a band, best first."""
        here, there = gram_codes(text, q), gram_codes(passage, q)
        order = np.argsort(there, kind="stable")
        lo, hi = np.searchsorted(there[order], here, "left"), np.searchsorted(there[order], here, "right")
        n = hi - lo
        pos = np.repeat(np.arange(len(here)), n)
        src = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(src, kind="stable")
        src, diagonal = src[order], (pos - src)[order]
        start, end = _runs(passage, words)
        out = []
        for band in bands:
            ok = (diagonal // HALF == band) | (diagonal // HALF == band + 1)
            own, place = diagonal[ok], src[ok]
            a, b = np.searchsorted(place, start), np.searchsorted(place, end - q + 1)
            less = (end - start - q + 1 - q * edits) - (b - a)
            for j in np.flatnonzero(less <= 0):
                part = own[a[j] : b[j]]
                out.append((int(less[j]), int(start[j]), int(end[j]), int(part.min()) - edits, int(part.max()) + edits))
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts, tb = code_points(batch.column("t").to_pylist())
                items, ib = code_points(batch.column("p").to_pylist())
                bands = batch.column("bands").to_pylist()
                text, item = (lambda i: texts[tb[i] : tb[i + 1]]), (lambda i: items[ib[i] : ib[i + 1]])
                open_ = {i: candidates(text(i), item(i), bands[i]) for i in range(batch.num_rows)}
                rows, place = [], 0
                while now := [(i, *c[place][1:]) for i, c in open_.items() if place < len(c)]:
                    # The most likely run of each pair first; a pair goes on with its next one only if that fails.
                    i, start, end, low, high = (list(x) for x in zip(*now, strict=True))
                    begin = [max(0, s + x) for s, x in zip(start, low, strict=True)]
                    cost = aligned(
                        [item(i)[s:e] for i, s, e in zip(i, start, end, strict=True)],
                        [text(i)[b : b + e - s + h - x + 1] for i, b, s, e, x, h in zip(i, begin, start, end, low, high, strict=True)],
                        np.array(start) + low - begin,
                        np.array(start) + high - begin,
                    )
                    found = [i for i, x in zip(i, cost, strict=True) if x <= edits]
                    rows += found
                    for i in found:
                        del open_[i]
                    place += 1
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("d").take(take), batch.column("k").take(take)], names=["d", "k"])

    return run


def leaked_items(
    corpus: DataFrame,
    items: DataFrame,
    words: int = 12,
    edits: int = 0,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    passage: str = "passage",
) -> DataFrame:
    """(doc_id, item_id), once each, wherever a corpus text holds `words` or more consecutive words of an item's passage.

    Words are runs of letters and digits, compared without letter case after both texts are brought to the one
    form of `canon`, and joined by single spaces. With edits > 0 a stretch counts as well that at most so many
    insertions, deletions or changes of a character (of these words, spaces included) turn into such a run.

    The corpus is scanned once, whatever the number of items, and never shuffled: only stretches that hold
    enough q-grams of the items leave the scan, with these q-grams. Items stay distributed. Of each run only
    its rarest q-grams among the items are kept, q * edits + 8 of them; as edits can destroy q * edits at most,
    8 of them must still be shared on one band of diagonals, so no leak is lost, and phrases many items have do
    not bring all of them together. The driver holds a bit filter of at most 16 MB. Hits meet the items'
    q-grams in an equi-join and are counted by (stretch, item, band) with partial aggregation.

    NULL, empty and blank texts or passages, and passages of fewer than `words` words, leak nowhere. Repeated
    rows of either side change nothing. Empty inputs give no rows. Other columns are ignored. More edits than
    leave one q-gram of the shortest run whole raise ValueError, as does words < 1.
    """
    if words < 1 or edits < 0:
        raise ValueError("words must be 1 or more, edits 0 or more")
    spark = corpus.sparkSession
    scratch = Scratch(spark, "leaks")
    tables = spark.sparkContext.broadcast(word_tables())
    held = items.select(F.col(item_key).alias("k"), F.col(passage).alias("t")).where("t is not null and k is not null").distinct()
    kind, corpus_kind = dict(held.dtypes)["k"], dict(corpus.dtypes)[key]
    held = scratch.keep(held.mapInArrow(_items(tables, words), f"k {kind}, t string, low long, high long").withColumn("n", F.monotonically_increasing_id()))
    low, high, total = held.agg(F.min("low"), F.max("high"), F.count(F.lit(1))).first()
    if low is None:
        return spark.createDataFrame([], f"`{key}` {corpus_kind}, `{item_key}` {kind}")
    q = min(Q, low // (edits + 1))
    if q < 1:
        raise ValueError(f"{edits} edits can change every character of a run of {low}")
    grams = scratch.keep(held.select("n", "t").mapInArrow(_item_grams(q), "n long, src long, code long"))
    grams = grams.join(grams.groupBy("code").agg(F.count(F.lit(1)).alias("held")), "code")
    # Some 64 items a group: one alone is too little for a call.
    some = lambda df: df.groupBy(F.pmod("n", F.lit(1 + total // 64)))
    index = some(grams).cogroup(some(held)).applyInPandas(_rarest(q, edits, words), f"k {kind}, n long, src long, code long, need long")
    index = scratch.keep(index)
    count, need = index.agg(F.count(F.lit(1)), F.min("need")).first()
    size = min(27, max(16, (16 * count).bit_length()))
    place = index.select(F.shiftrightunsigned("code", 64 - size).alias("place"))
    # At most 2^21 numbers, whatever the items.
    marked = place.groupBy(F.expr("place >> 6").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).collect()
    bits = np.zeros(1 << (size - 6), np.uint64)
    for r in marked:
        bits[r.i] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
    # Bit i of a word is place i, so each byte is turned round for unpackbits, which begins at the highest.
    packed = np.packbits(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    marks = spark.sparkContext.broadcast(packed)
    rows = corpus.select(F.col(key).alias("d"), F.col(text).alias("t")).where("t is not null")
    reach = high + 2 * edits + 2
    stretches = rows.mapInArrow(_scan(tables, marks, q, reach, need), f"d {corpus_kind}, t string, pos array<long>, code array<long>")
    stretches = scratch.keep(stretches.withColumn("w", F.monotonically_increasing_id()))
    hits = stretches.select("w", F.explode(F.arrays_zip("pos", "code")).alias("h")).select("w", "h.pos", "h.code")
    met = hits.join(index, "code").withColumn("b", F.floor((F.col("pos") - F.col("src")) / HALF))
    met = met.select("w", "n", "need", F.explode(F.array(F.col("b"), F.col("b") - 1)).alias("band"))
    bands = met.groupBy("w", "n", "band").agg(F.count(F.lit(1)).alias("shared"), F.max("need").alias("need")).where("shared >= need")
    pairs = scratch.keep(bands.groupBy("w", "n").agg(F.sort_array(F.collect_list("band")).alias("bands")))
    open_ = pairs.join(stretches.select("w", "d", "t"), "w").join(held.select("n", "k", F.col("t").alias("p")), "n")
    return open_.select("d", "k", "t", "p", "bands").mapInArrow(_verify(q, edits, words), f"d {corpus_kind}, k {kind}").distinct().select(F.col("d").alias(key), F.col("k").alias(item_key))
