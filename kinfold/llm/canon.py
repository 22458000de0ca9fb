"""Problem 9: visually identical text written with different characters.

The one form of a text has: no invisible characters; plain space for every space character of one
width or another; plain letters for full-width, half-width and joined forms; one letter for letters
that look alike in Latin, Greek and Cyrillic (the Latin one); and composed accents. Letter case,
missing accents, punctuation, digits and the number of spaces stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, small
from .codepoints import ASSIGNED, CodeTable, picked, pieces, replaced, strings, text_codes

# Greek and Cyrillic letters that look like a Latin letter, and that letter.
LOOK_ALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
}

# Format characters that are visible, so not removed.
VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, *range(0xFFF9, 0xFFFC), *range(0x13430, 0x13440)}

# Code points that show nothing but are not of the format category: the grapheme joiner, variation selectors.
OTHER_INVISIBLE = {0x034F, *range(0x180B, 0x180E), 0x180F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


@lru_cache(maxsize=1)
def character_map() -> dict[int, str]:
    """Code point to its replacement ('' to remove it), by rule from the Unicode character data."""
    out: dict[int, str] = {}
    for cp in ASSIGNED:
        c = chr(cp)
        kind = unicodedata.category(c)
        if cp in OTHER_INVISIBLE or (kind == "Cf" and cp not in VISIBLE_FORMAT) or (kind == "Cc" and not c.isspace()):
            out[cp] = ""
        elif kind == "Zs" and c != " ":
            out[cp] = " "
        elif 0x370 <= cp < 0x530 or 0x1F00 <= cp < 0x2000:
            parts = unicodedata.normalize("NFD", c)
            plain = unicodedata.normalize("NFC", "".join(LOOK_ALIKE.get(x, x) for x in parts))
            if plain != c and any(x in LOOK_ALIKE for x in parts):
                out[cp] = plain
        elif unicodedata.decomposition(c).split(" ")[0] in ("<wide>", "<narrow>") or cp in range(0xFB00, 0xFB18) or cp in (0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)):
            out[cp] = unicodedata.normalize("NFKC", c)
    return out


def one_form(text: str) -> str:
    """The one form of a text, on the driver or in a Python worker."""
    return unicodedata.normalize("NFC", text.translate(character_map()))


@lru_cache(maxsize=1)
def unstable() -> np.ndarray:
    """Whether a code point, once mapped, can change or be changed by the composition of accents."""
    out = np.zeros(0x110000, bool)
    letters = {chr(cp): unicodedata.normalize("NFD", chr(cp)) for cp in ASSIGNED if cp >= 0x80 and not 0xD800 <= cp < 0xE000}
    later = {x for parts in letters.values() for x in parts[1:]}
    moved = {c for c in letters if c in later or unicodedata.combining(c) or 0x1100 <= ord(c) < 0x1200 or unicodedata.normalize("NFC", c) != c}
    out[[ord(c) for c in moved]] = True
    for cp, text in character_map().items():
        out[cp] = any(c in moved for c in text)
    return out


def composed(cps: np.ndarray, ends: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mapped texts with accents composed; only those marked loose are looked at."""
    at = np.flatnonzero(loose)
    return replaced(cps, ends, at, [unicodedata.normalize("NFC", t) for t in picked(cps, ends, at)])


def any_in(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether any mark lies in each text."""
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[ends[1:]] > total[ends[:-1]]


def _formed(table: CodeTable, unstable: np.ndarray, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, cps, ends in pieces(column):
        loose = any_in(unstable[cps], ends)
        yield lo, hi, *composed(*table.apply(cps, ends), loose)


@lru_cache(maxsize=1)
def skeleton_map() -> dict[int, str]:
    """Code point to its one form without accents: equal for all writings that composition makes equal, and for some others.

    All that follow the first character of any decomposition go, spacing vowel signs and Hangul vowels among
    them, as do all marks that composition can reorder; what is left of a character is the first of its parts.
    """
    letters = {chr(cp): unicodedata.normalize("NFD", chr(cp)) for cp in ASSIGNED if cp >= 0x80 and not 0xD800 <= cp < 0xE000}
    later = {x for parts in letters.values() for x in parts[1:]}
    goes = lambda c: c in later or unicodedata.combining(c) != 0 or unicodedata.category(c) == "Mn"
    bare = {c: "" if goes(c) or goes(parts[0]) else parts[0] for c, parts in letters.items()}
    out = {ord(c): b for c, b in bare.items() if b != c}
    return out | {cp: "".join(bare.get(c, c) for c in text) for cp, text in character_map().items()}


@lru_cache(maxsize=1)
def visible() -> np.ndarray:
    """Whether a code point shows anything in the one form."""
    out = np.ones(0x110000, bool)
    out[[9, 10, 11, 12, 13, 32]] = False
    for cp, text in character_map().items():
        out[cp] = any(c not in "\t\n\v\f\r " for c in text)
    return out


def _codes(shared):
    """A code of the skeleton of each text that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shown = shared.value
        for batch in batches:
            for lo, hi, cps, ends in pieces(batch.column("t")):
                seen = any_in(shown[cps], ends)
                rows = batch.slice(lo, hi - lo).select(["id", "rh"]).filter(pa.array(seen))
                code = text_codes(*table.apply(cps, ends))[seen].view(np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(code)], names=["id", "rh", "ck"])

    return run


def _forms(shared):
    """The one form of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, cps, ends in _formed(*shared.value, batch.column("t")):
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rows.column("ck"), rows.column("rh"), rows.column("id"), strings(cps, ends)], names=["ck", "rh", "id", "m"])

    return run


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, variant, canonical_key) of every row whose text reads the same as a differently written one.

    Candidates: all texts are mapped once, over whole batches (see `codepoints`), and only three numbers a row
    come out: key, a hash of the raw text, and a code of the mapped text without accents, which is equal
    wherever the forms are. Codes held by one raw text (plain copies of any number) end there, by partial
    aggregation; one text for each remaining (code, raw hash) follows.

    Classes: these texts in their one form are grouped under the accent- and case-sensitive Unicode collation;
    the smallest form of a group, in code-point order, is its canonical member and is joined back to all of the
    group. A collation can ignore differences that count here, so a group is split by the exact form: class_id
    is its digest, and a class is one (canonical member, class_id). canonical_key is the smallest key of the
    canonical member. `variant` numbers are hashes of the raw text: equal for equal texts, different within a
    class otherwise.

    NULL, empty and blank texts (blank once invisible characters are gone) belong to no class. Repeated keys
    give repeated rows, whose texts may differ. An empty input gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "canon")
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("rh"), F.col(text).alias("t")).where("t is not null")
    bare = spark.sparkContext.broadcast((CodeTable.of(skeleton_map()), visible()))
    coded = scratch.keep(rows.mapInArrow(_codes(bare), f"id {kind}, rh long, ck long"))
    several = coded.groupBy("ck").agg(F.min("rh").alias("lo"), F.max("rh").alias("hi")).where("lo <> hi").select("ck")
    members = scratch.keep(coded.join(several, "ck"))
    firsts = small(scratch.keep(members.groupBy("ck", "rh").agg(F.min("id").alias("id"))))
    writings = rows.join(firsts, ["id", "rh"]).select("ck", "rh", "id", "t")
    form = spark.sparkContext.broadcast((CodeTable.of(character_map()), unstable()))
    held = scratch.keep(writings.mapInArrow(_forms(form), f"ck long, rh long, id {kind}, m string").dropDuplicates(["ck", "rh"]))
    groups = held.groupBy(F.collate("m", "UNICODE").alias("c")).agg(F.min(F.struct("m", "id")).alias("canonical"))
    joined = held.withColumn("c", F.collate("m", "UNICODE")).join(groups, "c")
    classes = joined.select("ck", "rh", F.col("canonical.id").alias("canonical_key"), F.sha2("m", 256).alias("class_id"))
    whole = ["canonical_key", "class_id"]
    several = classes.groupBy(*whole).agg(F.min("rh").alias("lo"), F.max("rh").alias("hi")).where("lo <> hi").select(*whole)
    classes = scratch.keep(classes.join(several, whole))
    return members.join(classes, ["ck", "rh"]).select(F.col("id").alias(key), "class_id", F.col("rh").alias("variant"), "canonical_key")


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b), smaller first, of all rows with texts written differently that read the same.

    Rows are those of one class of `look_alike_classes`: one canonical member of a collation group, one exact
    form. Pairs of writings are formed first, one row per distinct writing, then rows are joined to them: rows
    with equal texts never meet. What comes out is what is asked for, so it is as large as the number of such
    pairs; `look_alike_classes` is the form that grows with the rows alone.
    NULL, empty and blank texts pair with nothing. An empty input gives no rows.
    """
    scratch = Scratch(df.sparkSession, "pairs")
    whole = ["canonical_key", "class_id"]
    rows = scratch.keep(look_alike_classes(df, key, text).select(F.col(key).alias("id"), *whole, "variant"))
    kinds = rows.select(*whole, "variant").distinct()
    two = kinds.join(kinds.withColumnRenamed("variant", "other"), whole).where("variant < other")
    left = two.join(rows, [*whole, "variant"]).withColumnRenamed("id", "a")
    right = rows.select(*whole, F.col("variant").alias("other"), F.col("id").alias("b"))
    met = left.join(right, [*whole, "other"])
    return met.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
