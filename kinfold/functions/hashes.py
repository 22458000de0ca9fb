"""Reading of digests and perceptual hashes as they are written in catalogues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_BITS = 4


def digest(text: Column) -> Column:
    """The 64 lower-case hex digits of the 32-byte digest a text stands for, else NULL.

    Letter case, outer white space and a leading algorithm name do not count. NULL, empty and
    malformed texts give NULL.
    """
    bare = F.regexp_extract(F.lower(text), r"^\s*(?:sha-?256\s*[:=]?\s*)?([0-9a-f]{64})\s*$", 1)
    return F.when(bare != "", bare)


def hash_bits(text: Column) -> Column:
    """A 16-digit hex hash as BIGINT, NULL for anything else; a 0x prefix, letter case and outer blanks do not count."""
    bare = F.regexp_extract(F.lower(text), r"^\s*(?:0x)?([0-9a-f]{16})\s*$", 1)
    return F.when(bare != "", F.conv(bare, 16, -10).cast("bigint"))


def usable_hash(text: Column, min_bits: int = MIN_BITS) -> Column:
    """hash_bits, but NULL where fewer than min_bits bits are set or unset: flat pictures all share such hashes."""
    bits = hash_bits(text)
    return F.when(F.bit_count(bits).between(min_bits, 64 - min_bits), bits)


def bits_apart(a: Column, b: Column) -> Column:
    """Differing bits of two BIGINT hashes; NULL if either is."""
    return F.bit_count(a.bitwiseXOR(b))
