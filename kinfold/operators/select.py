"""Choosing rows: by pattern, by threshold, by rank within the group; and the orders rows are shown in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import parse_threshold
from ..functions.paths import basename, device_key, folder

# Comparisons that a pattern may name.
COMPARISONS = (">", ">=", "<", "<=", "==", "!=")
NUMERIC = ("Size (Bytes)", "Group Count", "Similarity", "Score", "Creation Date", "Shot Date")
DATES = ("Creation Date", "Shot Date")
TIER = {"KEEP": 1, "UNDATED": 1, "": 1, "EXACT": 2, "REVIEW_DUPLICATE": 3}


def decimal_text(x: Column) -> Column:
    """A double as it is usually read: 0.0005 rather than 5.0E-4; an exponent only below 1e-4 and from 1e16, as in 1e-05."""
    text = x.cast("string")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    figures = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?(.*)E", 1), r"\.0$", ""), r"\.", "")
    rest = F.substr(figures, F.lit(2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
    padded = F.rpad(figures, F.greatest(power + 2, F.length(figures)), "0")
    large = F.concat(F.left(padded, power + 1), F.lit("."), F.substr(padded, power + 2))
    tiny = F.concat(F.left(figures, F.lit(1)), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    spelled = F.when(power.between(-4, -1), small).when(power.between(0, 15), large).otherwise(tiny)
    named = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(named, F.when(power.isNull(), text).otherwise(F.concat(sign, spelled)))


def date_text(x: Column) -> Column:
    """A time as text, its fraction, if any, in six digits."""
    text = x.cast("string")
    fraction = F.regexp_extract(text, r":\d{2}\.(\d{1,5})$", 1)
    return F.when(fraction != "", F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(fraction, 6, "0"))).otherwise(text)


def text_field(name: str) -> Column:
    """A field of a manifest row as text; NULL for fields without a text (Similarity, Group Count)."""
    path = F.col("source_path")
    fields = {
        "File Name": basename(path),
        "Folder": folder(path),
        "Action": F.col("user_decision"),
        "Score": decimal_text(F.col("score")),
        "Size (Bytes)": F.col("file_size_bytes").cast("string"),
        "Resolution": F.when((F.col("pixel_width") != 0) & (F.col("pixel_height") != 0), F.concat_ws("×", "pixel_width", "pixel_height")),
        "Creation Date": date_text(F.col("creation_date")),
        "Shot Date": date_text(F.col("shot_date")),
        "Lock": F.when(F.col("is_locked").cast("int") != 0, "Locked").otherwise(""),
    }
    return fields.get(name, F.lit(None).cast("string"))


def with_number(rows: DataFrame, name: str, to: str, group: str = "group_id") -> DataFrame:
    """Adds a field as a number: dates as epoch seconds (UTC), Similarity as the stored distance, Group Count as the group's present size.

    Sizes are counted per group and joined back, so no group is gathered.
    """
    if name != "Group Count":
        return rows.withColumn(to, numeric_field(name))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias(to)).withColumnRenamed(group, "_g")
    return rows.join(sizes, rows[group].eqNullSafe(sizes["_g"])).drop("_g")


def numeric_field(name: str) -> Column:
    """A field of a row as a number; NULL for fields that are none or that need more than the row."""
    when = lambda c: F.unix_micros(F.col(c).try_cast("timestamp_ntz").cast("timestamp")) / 1e6
    fields = {
        "Size (Bytes)": lambda: F.col("file_size_bytes").cast("double"),
        "Similarity": lambda: F.col("hamming_distance").cast("double"),
        "Score": lambda: F.when(~F.isnan("score"), F.col("score")),
        "Creation Date": lambda: when("creation_date"),
        "Shot Date": lambda: when("shot_date"),
    }
    return fields[name]() if name in fields else F.lit(None).cast("double")


def best_per_group(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, source_path): the row of the highest score, ties to the smallest path; groups and rows without either are left out."""
    usable = rows.where(F.col(group).isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), "source_path")
    return usable.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(group, "source_path")


def rank_in_group(rows: DataFrame, field: str, n: int, descending: bool = True, group: str = "group_id") -> DataFrame:
    """The rows among the n highest (or lowest) of their group by a numeric field, with value and place; ties by path upward either way.

    NULL values take no part; n below 1 gives no rows. The filter on the place becomes a group limit before the shuffle.
    """
    held = with_number(rows, field, "value", group).where(F.col("value").isNotNull() & F.col(group).isNotNull())
    key = F.col("value").desc() if descending else F.col("value").asc()
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(key, "source_path")))
    return placed.where(F.col("place") <= max(n, 0))


def by_threshold(rows: DataFrame, field: str, op: str, threshold: str, group: str = "group_id") -> DataFrame:
    """Rows whose numeric field compares so with the threshold; none if either the threshold or the comparison cannot be read."""
    limit = parse_threshold(threshold, field in DATES)
    if limit is None or op not in COMPARISONS:
        return rows.where(F.lit(False))
    held = with_number(rows, field, "_v", group)
    compare = {">": F.col("_v") > limit, ">=": F.col("_v") >= limit, "<": F.col("_v") < limit, "<=": F.col("_v") <= limit, "==": F.col("_v") == limit, "!=": F.col("_v") != limit}
    return held.where(compare[op]).drop("_v")


def by_pattern(rows: DataFrame, field: str, pattern: str) -> DataFrame:
    """Rows whose text field holds a match of the expression, in any letter case; NULL never matches, an empty expression raises ValueError."""
    if not pattern:
        raise ValueError("the pattern is empty")
    return rows.where(text_field(field).rlike(f"(?iu){pattern}"))


def simple_pattern(op: str, text: str) -> str:
    """contains, starts_with, ends_with or exact as an expression; without text '' (which is rejected), but exact fits empty fields."""
    quoted = re.escape(text)
    if op == "exact":
        return f"^{quoted}$"
    forms = {"contains": quoted, "starts_with": f"^{quoted}", "ends_with": f"{quoted}$"}
    if op not in forms:
        raise ValueError(f"unknown operator {op}")
    return forms[op] if text else ""


def read_simple_pattern(pattern: str) -> tuple[str, str] | None:
    """(operator, text) of an expression that simple_pattern could have written, else None."""
    start, end = pattern.startswith("^"), pattern.endswith("$") and not pattern.endswith("\\$")
    body = pattern[start : len(pattern) - end]
    text = re.sub(r"\\(.)", r"\1", body, flags=re.S)
    if re.escape(text) != body or (not text and not (start and end)):
        return None
    return {(True, True): "exact", (True, False): "starts_with", (False, True): "ends_with", (False, False): "contains"}[start, end], text


def select(rows: DataFrame, field: str, pattern: str, group: str = "group_id") -> DataFrame:
    """Rows by a field and a pattern: `__cmp__:OP:VALUE`, `__top_n__:N:asc|desc`, or else an expression. Malformed ones raise ValueError."""
    if pattern.startswith("__cmp__:"):
        parts = pattern.split(":", 2)
        if len(parts) != 3 or parts[1] not in COMPARISONS:
            raise ValueError(f"malformed comparison {pattern}")
        return by_threshold(rows, field, parts[1], parts[2], group)
    if pattern.startswith("__top_n__:"):
        parts = pattern.split(":")
        if len(parts) != 3 or not re.fullmatch(r"[+-]?\d+", parts[1]) or parts[2] not in ("asc", "desc"):
            raise ValueError(f"malformed rank {pattern}")
        return rank_in_group(rows, field, int(parts[1]), parts[2] == "desc", group).drop("value", "place")
    return by_pattern(rows, field, pattern)


def match_statistics(rows: DataFrame, field: str, pattern: str, samples: int = 50) -> DataFrame:
    """One row (matched, total, samples): rows that match, all rows, and the first of the matching values in their order."""
    value = text_field(field)
    hit = F.coalesce(value.rlike(f"(?iu){pattern}"), F.lit(False))
    held = rows.select(value.alias("v"), hit.alias("hit"))
    counts = held.agg(F.count_if("hit").alias("matched"), F.count(F.lit(1)).alias("total"))
    shown = held.where("hit").orderBy("v").limit(samples).agg(F.sort_array(F.collect_list("v")).alias("samples"))
    return counts.join(shown, F.lit(True))


def tier(action: Column) -> Column:
    """1 for kept rows, 2 exact, 3 near duplicates, 4 anything else; NULL counts as ''."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TIER.items() for x in kv])[F.coalesce(action, F.lit(""))], F.lit(4))


def load_order() -> list[Column]:
    return [F.col("group_id").asc_nulls_last(), tier(F.col("action")), F.col("id")]


def sort_keys(rows: DataFrame, keys: list[tuple[str, bool]], legacy_text: bool = False) -> list[Column]:
    """Columns to order by, from (column, ascending): NULL counts as 0 or ''. legacy_text sorts texts and dates upward whatever is asked."""
    kinds = dict(rows.dtypes)
    out = []
    for name, ascending in keys:
        number = kinds[name] in ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean") or kinds[name].startswith("decimal")
        filled = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if number else F.coalesce(F.col(name).cast("string"), F.lit(""))
        out.append(filled.asc() if ascending or (legacy_text and not number) else filled.desc())
    return out


def with_score_first(keys: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """The keys with score downward before them, unless they name score themselves."""
    return keys if any(k == "score" for k, _ in keys) else [("score", False), *keys]


def header_order(rows: DataFrame, column: str, ascending: bool = True) -> list[Column]:
    """Order of a clicked column header: texts in any letter case, no score as -1, no date or number as 0."""
    kind = dict(rows.dtypes)[column]
    c = F.lower(F.col(column)) if kind == "string" else F.coalesce(F.col(column).cast("double"), F.lit(-1.0 if column == "score" else 0.0))
    return [c.asc() if ascending else c.desc()]


def stratified(rows: DataFrame, n: int, path: str = "source_path", order: str = "id") -> DataFrame:
    """n rows dealt round by round over the devices of their paths, devices in order of first appearance."""
    held = rows.withColumn("_dev", device_key(F.col(path)))
    dealt = held.withColumn("_round", F.row_number().over(Window.partitionBy("_dev").orderBy(order))).where(F.col("_round") <= n)
    first = held.groupBy("_dev").agg(F.min(order).alias("_first"))
    return dealt.join(first, "_dev").orderBy("_round", "_first").limit(n).drop("_dev", "_round", "_first")


def limit_per_source(rows: DataFrame, limits: dict[str, int], label: str = "source_label", order: str = "id") -> DataFrame:
    """At most the given number of rows of each source, the first by order; sources not named keep all."""
    if not limits:
        return rows
    named = F.coalesce(F.col(label).isin(*limits), F.lit(False))
    most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col(label)]
    placed = rows.where(named).withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(order)))
    # The constant bound becomes a group limit before the shuffle.
    cut = placed.where((F.col("_n") <= max(limits.values())) & (F.col("_n") <= most)).drop("_n")
    return rows.where(~named).unionByName(cut)
