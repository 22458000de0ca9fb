"""Scalar functions for the review: distances, colours, shares, durations."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashes import bits_apart


def hex_hash(text: Column) -> Column:
    """A hex hash as BIGINT; NULL if absent, empty or malformed (and not exactly 16 digits)."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; NULL if either is absent or malformed."""
    return bits_apart(hex_hash(a), hex_hash(b))


def colour(text: Column) -> Column:
    """'R,G,B' as array<int>; NULL if absent, empty or malformed."""
    return F.when(text.rlike(r"^\s*\d+\s*,\s*\d+\s*,\s*\d+\s*$"), F.transform(F.split(text, ","), lambda x: F.trim(x).cast("int")))


def colour_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two 'R,G,B' texts; NULL if either is absent."""
    part = lambda t, i: F.split(t, ",")[i].try_cast("double")
    return F.sqrt(sum(((part(a, i) - part(b, i)) * (part(a, i) - part(b, i)) for i in range(3)), F.lit(0.0)))


def similarity_percent(distance: Column, otherwise: str = "near-dup") -> Column:
    """Share of equal bits of 64 as text; halves round to even."""
    share = F.bround((64 - distance) / F.lit(64.0) * 100, 0).cast("int")
    return F.when(distance.isNull(), otherwise).otherwise(F.concat(share.cast("string"), F.lit("%")))


def score_text(score: Column) -> Column:
    """Two decimals of the binary value itself (0.615 is a little below that in binary, so 0.61), halves to even; a dash if NULL.

    Between 0 and 1 the double is a whole number of 2^-62, so hundredths are compared exactly as decimals; other values are
    rendered by their shortest digits.
    """
    unit = F.lit(1 << 62).cast("decimal(20,0)")
    hundred = (score * float(1 << 62)).try_cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    k = F.floor(hundred / unit).cast("decimal(3,0)")
    k = F.when(hundred - k * unit < 0, k - 1).otherwise(k)
    rest = (hundred - k * unit) * 2
    up = F.when(rest > unit, 1).when(rest < unit, 0).otherwise(F.pmod(k.cast("int"), F.lit(2)))
    cents = k.cast("int") + up
    exact = F.format_string("%d.%02d", F.floor(cents / 100), F.pmod(cents, F.lit(100)))
    inside = score.between(2.0**-9, 1.0)
    return F.when(score.isNull() | F.isnan(score), "—").when(inside, exact).otherwise(F.format_string("%.2f", score))


def resolution_text(width: Column, height: Column, times: str = "*") -> Column:
    """W*H if both are above 0, else ''."""
    return F.when((width > 0) & (height > 0), F.concat(width.cast("string"), F.lit(times), height.cast("string"))).otherwise("")


def aspect_bucket(resolution: Column) -> Column:
    """0 landscape, 1 square or unknown, 2 portrait, of a 'W*H' text."""
    w, h = (F.regexp_extract(resolution, r"^(\d+)\*(\d+)$", i).try_cast("bigint") for i in (1, 2))
    return F.when(w > h, 0).when(w < h, 2).otherwise(1)


def duration_text(ms: Column) -> Column:
    """MM:SS below an hour, HH:MM:SS from then on; --:-- if negative or NULL."""
    s = F.floor(ms / 1000)
    pad = lambda x: F.format_string("%02d", x.cast("bigint"))
    hours, minutes, seconds = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    long = F.concat(pad(hours), F.lit(":"), pad(minutes), F.lit(":"), pad(seconds))
    short = F.concat(pad(F.floor(s / 60)), F.lit(":"), pad(seconds))
    return F.when(ms.isNull() | (ms < 0), "--:--").when(s >= 3600, long).otherwise(short)


def eta_text(remaining: Column, rate: Column) -> Column:
    """Time left at a rate: a dash without a rate, <1s, ~Ns, ~Nm SSs, ~Nh MMm."""
    s = remaining / F.when(rate > 0, rate)
    whole = F.floor(s).cast("bigint")
    m = F.format_string("~%dm %02ds", F.floor(whole / 60), whole % 60)
    h = F.format_string("~%dh %02dm", F.floor(whole / 3600), F.floor((whole % 3600) / 60))
    return (
        F.when(s.isNull() | (remaining <= 0), "—").when(s < 1, "<1s").when(whole < 60, F.format_string("~%ds", whole)).when(whole < 3600, m).otherwise(h)
    )


def exif_date(text: Column) -> Column:
    """'YYYY:MM:DD HH:MM:SS' from the first 19 characters as TIMESTAMP_NTZ; NULL for '', '-', zero dates and anything malformed."""
    t = F.substring(F.trim(text), 1, 19)
    ok = t.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$") & ~t.startswith("0000:")
    return F.when(ok, F.call_function("try_to_timestamp", t, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"))


def rating(text: Column) -> Column:
    """A whole number, NULL if the text is none."""
    return F.trim(text).try_cast("int")


def cache_key(path: Column, size: Column) -> Column:
    return F.sha1(F.concat(path, F.lit("|"), size.cast("string")))


def short_fingerprint(*parts: Column) -> Column:
    """16 hex digits that change whenever a part does; parts are told apart, and NULL from ''."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 16)


def parse_threshold(text: str | None, is_date: bool = False) -> float | None:
    """A threshold typed by a user: for dates three notations (as epoch seconds, UTC), then a number; None if neither."""
    text = (text or "").strip()
    if not text:
        return None
    if is_date:
        for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"):
            try:
                return datetime.datetime.strptime(text, form).replace(tzinfo=datetime.UTC).timestamp()
            except ValueError:
                continue
    try:
        return float(text)
    except ValueError:
        return None
