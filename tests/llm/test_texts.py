import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm.canon import any_in, character_map, composed, look_alike_classes, look_alike_pairs, one_form, skeleton_map, unstable
from kinfold.llm.codepoints import CodeTable, gram_codes, pieces, strings, text_codes
from kinfold.llm.leaks import aligned, leaked_items, word_tables, worded

DOC = "doc_id long, text string"
SAME = [
    ("Café", "Café"), ("ﬁne ﬂow", "fine flow"), ("ＡＢＣ１２", "ABC12"), ("a b", "a b"), ("a b", "a b"), ("a​b", "ab"), ("so­ft", "soft"),
    ("﻿start", "start"), ("раss", "pass"), ("ΑΒΕ", "ABE"), ("ё", "ë"), ("ё", "ë"), ("ガ", "ガ"), ("ｶﾞ", "ガ"), ("ў", "y̆"), ("ό", "ó"), ("ﬃ", "ffi"), ("ĳ", "ij"), ("Ή", "H́"), ("x︎y", "xy"),
]
DIFFERENT = [("a", "A"), ("é", "e"), ("a b", "a  b"), ("o", "0"), ("l", "1"), ("it's", "it’s"), ("a-b", "a–b"), ("かき", "カキ"), ("ß", "ss"), ("a\n", "a "), ("й", "и"), ("²", "2")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_one_form_makes_equal(a, b):
    assert one_form(a) == one_form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_one_form_keeps_apart(a, b):
    assert one_form(a) != one_form(b)


def formed(texts, size=64):
    table, loose, out = CodeTable.of(character_map()), unstable(), []
    for _, _, cps, ends in pieces(pa.array(texts), size):
        out += strings(*composed(*table.apply(cps, ends), any_in(loose[cps], ends))).to_pylist()
    return out


def test_whole_batches_agree_with_single_texts():
    rng = random.Random(4)
    pool = "ab éе́ﬁＡ０​ οΑἀΉўǆ　가가\U0001d41a\U000e0101\n'"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(400)] + [x for p in SAME + DIFFERENT for x in p] + ["", None, "x" * 500]
    assert formed(texts) == [one_form(t or "") for t in texts]
    assert formed(texts[3:9], 1) == [one_form(t) for t in texts[3:9]]
    chars = [chr(cp) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000]
    assert formed(chars, 1 << 16) == [one_form(c) for c in chars]


def test_codes_depend_on_the_text_alone():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé漢\U0001d41a") for _ in range(rng.randrange(6))) for _ in range(3000)]
    codes = np.concatenate([text_codes(c, e) for _, _, c, e in pieces(pa.array(texts), 100)])
    assert len({(t, int(c)) for t, c in zip(texts, codes, strict=True)}) == len(set(texts)) == len(set(codes.tolist()))
    line = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    grams = gram_codes(line, 4)
    assert len({(bytes(line[i : i + 4]), int(g)) for i, g in enumerate(grams)}) == len(set(grams.tolist()))


def test_pairs(spark):
    rows, want = [], set()
    for n, (a, b) in enumerate(SAME):
        rows += [(4 * n, f"{n} {a}"), (4 * n + 1, f"{n} {b}"), (4 * n + 2, f"{n} {b}")]
        want |= {(4 * n, 4 * n + 1), (4 * n, 4 * n + 2)}
    for n, (a, b) in enumerate(DIFFERENT):
        rows += [(1000 + 2 * n, f"d{n} {a}"), (1001 + 2 * n, f"d{n} {b}")]
    rows += [(5000, None), (5001, ""), (5002, " "), (5003, " "), (5004, "​"), (5005, "　")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC + ", m string, ck int")
    got = look_alike_pairs(frame).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hangul_in_parts(spark):
    got = look_alike_pairs(spark.createDataFrame([(1, "한글"), (2, unicodedata.normalize("NFD", "한글")), (3, "한국")], DOC)).collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def skeleton(text):
    return text.translate(skeleton_map())


def test_skeleton_is_the_same_for_all_compositions():
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            assert skeleton(c) == skeleton(unicodedata.normalize("NFD", c)) == skeleton(unicodedata.normalize("NFC", c)) == skeleton(one_form(c))


def test_skeleton_does_not_depend_on_the_order_of_marks():
    for m in (chr(cp) for cp in range(0x80, 0x110000) if unicodedata.combining(chr(cp))):
        for a, b in ((m, "\u0301"), ("\u0301", m), (m, "\u0334"), ("\u0334", m)):
            assert skeleton("x" + a + b) == skeleton(unicodedata.normalize("NFD", "x" + a + b))


def test_pairs_of_composed_and_decomposed_vowel_signs(spark):
    words = ["க\u0bcaக", "ক\u09cbক", "ക\u0d4aക", "ಕ\u0cc0ಕ", "ක\u0ddcක"]
    rows = [(2 * i + j, unicodedata.normalize(f, w)) for i, w in enumerate(words) for j, f in enumerate(("NFC", "NFD"))]
    got = look_alike_pairs(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(map(tuple, got)) == [(2 * i, 2 * i + 1) for i in range(len(words))]


def test_classes_have_one_canonical_member(spark):
    rows = [(3, "ABE"), (1, "ΑΒΕ"), (2, "АВЕ"), (4, "ABE"), (9, "other")]
    got = look_alike_classes(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4]
    assert {r.canonical_key for r in got} == {1}
    assert len({r.class_id for r in got}) == 1 and len({r.canonical_key for r in got}) == 1 and len({r.variant for r in got}) == 3


def test_texts_that_a_collation_parts_or_joins(spark):
    # Accents part classes of one skeleton; a control the collation ignores does not join two classes.
    rows = [(1, "cafe"), (2, "саfe"), (3, "café"), (4, "cafe\u0301"), (5, "caf\u00e8"), (6, "ca\ufffdfe"), (7, "ca\ufffdf\u0435")]
    got = look_alike_pairs(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (3, 4), (6, 7)]


def test_repeated_keys_keep_their_texts(spark):
    rows = [(1, "pass"), (1, "other"), (2, "раss"), (3, "оther")]
    got = look_alike_pairs(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 3)]


def test_a_hot_class_of_copies(spark):
    rows = [(i, "the same words") for i in range(300)] + [(1000 + i, "the same wоrds") for i in range(3)]
    got = look_alike_classes(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == 303 and len({(r.canonical_key, r.class_id) for r in got}) == 1 and len({r.variant for r in got}) == 2


def test_empty(spark):
    assert look_alike_pairs(spark.createDataFrame([], DOC)).collect() == []


ITEM = "item_id long, passage string, question string"
WORDS = "the quick brown fox jumps over a lazy dog while seven old sailors count their silver coins near some quiet harbour wall tonight".split()


def brute(docs, items, words=12):
    def runs(t):
        w = re.findall(r"[^\W_]+", one_form(t or "").lower())
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    held = {i: runs(p) for i, p, _ in items}
    return sorted((d, i) for d, t in docs for i, r in held.items() if r & runs(t))


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 40))) + rng.choice([".", ""]), "q") for i in range(30)]
    docs = []
    for d in range(150):
        own = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.8:
            w = rng.choice(items)[1].split()
            at, n = rng.randrange(max(1, len(w) - 10)), rng.randrange(8, 18)
            own[rng.randrange(len(own) + 1) :] = [x.upper() if rng.random() < 0.2 else x for x in w[at : at + n]] + own[:5]
        docs.append((d, rng.choice([" ", "  ", ", ", "\n", "_"]).join(own)))
    got = leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    want = brute(docs, items)
    assert want and sorted(map(tuple, got.collect())) == want


def distance(run, text):
    """Fewest edits between the run and any stretch of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(run, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def line(text):
    tables = word_tables()
    _, _, cps, ends = next(pieces(pa.array([text])))
    return worded(tables, cps, ends)[0].tobytes().decode("utf-32-le")


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_leaks_within_an_edit_budget(spark, edits):
    rng = random.Random(edits)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(10, 15))), "q") for i in range(4)]
    docs = []
    for d in range(14):
        w = rng.choice(items)[1].split()
        chars = list(" ".join(w[: rng.randrange(10, 18)]))
        for _ in range(rng.randrange(0, edits + 3)):
            i = rng.randrange(len(chars))
            chars[i : i + rng.choice([0, 1, 1])] = rng.choice(["", "x", "yz"[:1], " "])
        docs.append((d, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))) + " " + "".join(chars) + " tail"))
    want = []
    for d, t in docs:
        for i, p, _ in items:
            w = p.split()
            runs = [f" {' '.join(w[j : j + 12])} " for j in range(len(w) - 11)]
            if any(distance(r, line(t)) <= edits for r in runs):
                want.append((d, i))
    got = leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), edits=edits)
    assert want and sorted(map(tuple, got.collect())) == want


def test_one_letter_in_each_run_hides_no_leak(spark):
    w = WORDS * 2
    hidden = " ".join(x[:-1] + "#" + x[-1] if i % 11 == 5 else x for i, x in enumerate(w)).replace("#", "q")
    docs, items = spark.createDataFrame([(1, hidden)], DOC), spark.createDataFrame([(9, " ".join(w))], "item_id long, passage string")
    assert leaked_items(docs, items).collect() == []
    assert [tuple(r) for r in leaked_items(docs, items, edits=2).collect()] == [(1, 9)]


def test_banded_alignment_equals_the_whole_table():
    rng = random.Random(3)
    runs, texts = [], []
    for _ in range(200):
        r = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 15)))
        t = list(r)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randrange(2)] = rng.choice(["", "a", "b"])
        runs.append(r)
        texts.append("".join(rng.choice("abc ") for _ in range(rng.randrange(4))) + "".join(t))
    code = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)
    got = aligned([code(r) for r in runs], [code(t) for t in texts], np.full(200, -20), np.full(200, 20))
    assert got.tolist() == [distance(r, t) for r, t in zip(runs, texts, strict=True)]


def test_a_phrase_of_all_items_and_copies(spark):
    common = " ".join(WORDS[:10])
    items = [(i, f"{common} item{i} " + " ".join(WORDS[10:14])) for i in range(40)] + [(1, f"{common} item1 " + " ".join(WORDS[10:14]))]
    docs = [(i, f"{common} nothing else here") for i in range(50)] + [(100 + i, f"so {common} item{i} {WORDS[10]} and so on") for i in range(5)] + [(104, "again")]
    got = leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, passage string"))
    assert sorted(map(tuple, got.collect())) == [(100 + i, i) for i in range(5)]


def test_leaks_in_disguise_and_edges(spark):
    text = " ".join(WORDS[:12])
    items = [(1, text, None), (2, None, None), (3, "", None), (4, "too short", None), (5, text + " extra", None)]
    docs = [
        (1, text), (2, text.replace("o", "о")), (3, text.replace(" ", " ")), (4, text.upper()), (5, text.replace("quick", "qui​ck")), (6, " ".join(WORDS[:11])), (7, None), (8, ""), (9, " "),
        (10, text.replace(" ", "--")), (11, "x" + text + "x"), (12, "filler words here " * 20_000 + text), (13, text.replace("fox", "f0x")),
    ]
    frame = spark.createDataFrame([(*d, 1) for d in docs], DOC + ", item_id int")
    got = sorted(map(tuple, leaked_items(frame.drop("item_id"), spark.createDataFrame(items, ITEM)).collect()))
    assert got == sorted((d, i) for d in (1, 2, 3, 4, 5, 10, 12) for i in (1, 5))
    assert leaked_items(spark.createDataFrame([], DOC), spark.createDataFrame(items, ITEM)).collect() == []
    assert leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame([], ITEM)).collect() == []
    assert (6, 1) in set(map(tuple, leaked_items(frame, spark.createDataFrame(items, ITEM), words=3).collect()))
    with pytest.raises(ValueError):
        leaked_items(frame, spark.createDataFrame(items, ITEM), edits=100)
    named = spark.createDataFrame([(text, text, 3)], "t string, d string, code int")
    assert [tuple(r) for r in leaked_items(named, spark.createDataFrame([(text, text)], "k string, n string"), key="t", text="d", item_key="k", passage="n").collect()] == [(text, text)]
