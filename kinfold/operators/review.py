"""What a reviewer sees of the manifest: groups, counts, the reference of each group, similarity labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import hamming, similarity_percent
from ..functions.paths import basename, folder
from .select import tier

# How decisions rank when a group is sorted by them.
DECISION_RANK = {"delete": 1, "keep": 2, "ignore": 4}


def survivors(rows: DataFrame, group: str = "group_id", least: int = 2) -> DataFrame:
    """Rows of groups with at least two visible members. Counts are aggregated first and joined back, so no group is gathered."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return rows.join(sizes.select(group), group, "left_semi")


def visible(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("outcome", F.lit("")) == "")


def numbered(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Adds group_number from 1 in the order of group ids.

    Distinct ids are range-partitioned and counted per partition; only the counts, one a partition, are summed in one place.
    """
    ids = rows.where(F.col(group).isNotNull()).select(group).distinct()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from ..runtime import Scratch

    ranged = ids.repartitionByRange(parts, group).sortWithinPartitions(group).select(group, F.monotonically_increasing_id().alias("_at"))
    held = Scratch(rows.sparkSession, "numbers").keep(ranged.select(group, F.shiftrightunsigned("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in")))
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(held.join(F.broadcast(before), "_part").select(group, (F.col("_in") + F.col("_before") + 1).alias("group_number")), group)


def load(rows: DataFrame) -> DataFrame:
    """The manifest as loaded for review: visible rows of groups that still have two, with group_number."""
    return numbered(survivors(visible(rows)))


def photo_records(rows: DataFrame) -> DataFrame:
    """Review projection of loaded rows; no capture date is kept, an unknown size is 0."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) != 0
    return rows.select(
        "group_number", F.col("source_path").alias("file_path"), folder(F.col("source_path")).alias("folder_path"), F.coalesce("action", F.lit("")).alias("action"),
        F.coalesce("user_decision", F.lit("")).alias("user_decision"), F.coalesce("file_size_bytes", F.lit(0)).alias("file_size_bytes"),
        F.col("creation_date"), F.col("shot_date"), F.lit(None).cast("timestamp_ntz").alias("capture_date"), "pixel_width", "pixel_height",
        "hamming_distance", "phash", "score", flag("is_locked").alias("is_locked"),
    )


def action_histogram(rows: DataFrame, named: tuple[str, ...] = ("EXACT", "REVIEW_DUPLICATE", "UNDATED", "KEEP", "")) -> DataFrame:
    """(action, rows, percent): each named action and 'other', with its share of all rows to one decimal. NULL counts as ''."""
    bucket = F.coalesce("action", F.lit(""))
    bucket = F.when(bucket.isin(*named), bucket).otherwise("other")
    counts = rows.groupBy(bucket.alias("action")).agg(F.count(F.lit(1)).alias("rows"))
    # At most one row an action.
    return counts.withColumn("percent", F.round(F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy(F.lit(1))), 1))


def group_summary(rows: DataFrame) -> DataFrame:
    """One row (groups, grouped_rows, isolated_rows)."""
    return rows.agg(
        F.count_distinct("group_id").alias("groups"), F.count("group_id").alias("grouped_rows"), (F.count(F.lit(1)) - F.count("group_id")).alias("isolated_rows")
    )


def isolated_count(rows: DataFrame) -> DataFrame:
    """One row (isolated_rows): rows in review that no surviving group holds, never below 0."""
    shown = visible(rows)
    sizes = shown.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    kept = F.coalesce(F.sum(F.when(F.col("group_id").isNotNull() & (F.col("n") >= 2), F.col("n"))), F.lit(0))
    return sizes.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)) - kept, F.lit(0)).alias("isolated_rows"))


def baseline(rows: DataFrame) -> DataFrame:
    """One row (groups, grouped_rows, isolated_rows) after loading."""
    sizes = visible(rows).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    full = F.col("group_id").isNotNull() & (F.col("n") >= 2)
    total = F.coalesce(F.sum("n"), F.lit(0))
    grouped = F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0))
    return sizes.agg(F.count_if(full).alias("groups"), grouped.alias("grouped_rows"), (total - grouped).alias("isolated_rows"))


def group_rollup(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """One row a group with what its header sorts by."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in DECISION_RANK.items() for x in kv])[F.col("user_decision")], F.lit(3))
    seconds = lambda c: F.coalesce(F.min(F.floor(F.unix_micros(F.col(c).try_cast("timestamp_ntz").cast("timestamp")) / 1_000_000)), F.lit(0))
    pixels = F.coalesce(F.col("pixel_width"), F.lit(0)).cast("bigint") * F.coalesce("pixel_height", F.lit(0))
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.min(rank).alias("decision_rank"), F.max((F.coalesce(F.col("is_locked").cast("int"), F.lit(0)) != 0).cast("int")).alias("locked"),
        F.min(F.lower(basename(F.col("source_path")))).alias("first_name"), F.min(F.lower(folder(F.col("source_path")))).alias("first_folder"),
        F.max(F.coalesce("file_size_bytes", F.lit(0))).alias("largest"), F.count(F.lit(1)).alias("members"), seconds("creation_date").alias("created"),
        seconds("shot_date").alias("shot"), F.max(pixels).alias("pixels"),
        F.coalesce(F.max(F.when(~F.isnan("score"), F.col("score"))), F.lit(-1.0)).alias("score"),
    )


def reference_of_group(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, source_path, phash) of the row shown as reference: of the kept ones the highest score, then the smallest path; none if none is kept.

    A minimum over a struct, aggregated before the shuffle.
    """
    score = F.when(~F.isnan("score"), F.col("score"))
    key = F.struct(F.coalesce(-score, F.lit(float("inf"))).alias("k"), "source_path", "phash")
    kept = rows.where(F.col(group).isNotNull() & F.coalesce(tier(F.col("action")).isin(1, 4), F.lit(True)))
    return kept.groupBy(group).agg(F.min(key).alias("r")).select(group, "r.source_path", "r.phash")


def similarity_labels(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Adds similarity: 100% for exact copies, share of equal bits with the shown reference (stored distance if it cannot be had) for near ones,
    Ref for the reference, a starred share or a dash for other kept rows."""
    ref = reference_of_group(rows, group).select(group, F.col("source_path").alias("_ref"), F.col("phash").alias("_rp"))
    held = rows.join(ref, group, "left").withColumn("_d", hamming(F.col("_rp"), F.col("phash")))
    starred = F.regexp_replace(similarity_percent(F.col("_d")), "%$", "*%")
    label = (
        F.when(F.col("action") == "EXACT", "100%")
        .when(F.col("action") == "REVIEW_DUPLICATE", similarity_percent(F.coalesce("_d", "hamming_distance")))
        .when(F.col("_ref") == F.col("source_path"), "Ref")
        .when(F.col("_d").isNotNull(), starred)
        .otherwise("—")
    )
    return held.withColumn("similarity", label).drop("_ref", "_rp", "_d")


def nearest_member(rows: DataFrame, group: str = "group_id", key: str = "id", close: int = 8, small: int = 1000) -> DataFrame:
    """(key, nearest): the other member of the group with the fewest bits between the hashes, the first by key of equals; rows without hash have none.

    Members meet by hash value, not row by row: equal hashes of a group are one value with its two first keys. Values at most
    `close` bits apart meet by an index within the group. Values without such a neighbour are compared with all values of
    their group if these are no more than `small`; in larger groups the index is asked again for wider and wider radii, and
    only values more than 31 bits from all others, of which a large group has none but by design, are compared with all.
    """
    from ..functions.labels import hex_hash
    from ..runtime import Scratch
    from .similarity import hash_value_pairs

    scratch = Scratch(rows.sparkSession, "members")
    held = scratch.keep(rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), hex_hash(F.col("phash")).alias("h")).where("h is not null"))
    heads = scratch.keep(held.withColumn("_n", F.row_number().over(Window.partitionBy("g", "h").orderBy("k"))).where("_n <= 2").select("g", F.col("h").alias("o"), F.col("k").alias("other")))
    values = scratch.keep(held.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")))
    pairs = scratch.keep(hash_value_pairs(values.select("g", "h"), close, within=["g"]))
    both = pairs.select("g", F.col("a").alias("h"), F.col("b").alias("o"), "bits").unionByName(pairs.select("g", F.col("b").alias("h"), F.col("a").alias("o"), "bits"))
    alone = values.where("n = 1").select("g", "h").join(both.select("g", "h").distinct(), ["g", "h"], "left_anti")
    large = values.groupBy("g").count().where(F.col("count") > small).select("g")
    left = scratch.keep(alone.join(large, "g", "left_semi"))
    alone = alone.join(large, "g", "left_anti")
    for radius in (16, 20, 24, 31):
        if left.isEmpty():
            break
        pairs = scratch.keep(hash_value_pairs(values.join(left.select("g").distinct(), "g", "left_semi").select("g", "h"), radius, within=["g"]))
        wider = pairs.select("g", F.col("a").alias("h"), F.col("b").alias("o"), "bits").unionByName(pairs.select("g", F.col("b").alias("h"), F.col("a").alias("o"), "bits"))
        wider = scratch.keep(wider.join(left, ["g", "h"], "left_semi"))
        both = both.unionByName(wider)
        left = scratch.keep(left.join(wider.select("g", "h").distinct(), ["g", "h"], "left_anti"))
    far = alone.union(left).join(values.select("g", F.col("h").alias("o")), "g").where("h <> o").select("g", "h", "o", F.expr("bit_count(h ^ o)").alias("bits"))
    own = values.select("g", "h", F.col("h").alias("o"), F.lit(0).alias("bits"))
    near = (
        both.unionByName(far).unionByName(own).join(heads, ["g", "o"])
        .withColumn("_n", F.row_number().over(Window.partitionBy("g", "h").orderBy("bits", "other")))
        .where("_n <= 2")
        .groupBy("g", "h")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "other"))).alias("near"))
    )
    pick = F.get(F.filter("near", lambda x: x["other"] != F.col("k")), F.lit(0))["other"]
    return held.join(near, ["g", "h"]).select(F.col("k").alias(key), pick.alias("nearest"))


def of_decision(rows: DataFrame, decision: str | None) -> DataFrame:
    """Rows of one decision; all of them for None."""
    return rows if decision is None else rows.where(F.coalesce("user_decision", F.lit("")) == decision)


def decided_groups(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """Whole groups in which any row has a decision."""
    some = rows.where(F.col("user_decision") != "").select(group).where(F.col(group).isNotNull()).distinct()
    return rows.join(some, group, "left_semi")


def whole_groups(rows: DataFrame, selected: DataFrame, group: str = "group_id") -> DataFrame:
    """All members of the groups that hold a selected path (selected: source_path)."""
    groups = rows.join(selected.select("source_path").distinct(), "source_path", "left_semi").select(group).where(F.col(group).isNotNull()).distinct()
    return rows.join(groups, group, "left_semi")


def any_decided(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """One row (found): whether a selected path has a decision."""
    return rows.where(F.col("user_decision") != "").join(selected.select("source_path").distinct(), "source_path", "left_semi").agg((F.count(F.lit(1)) > 0).alias("found"))


def keeper_paths(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("action") == "KEEP") & (F.col("source_path") != "")).select("source_path").distinct()


def counters(rows: DataFrame, decision: str | None = None) -> DataFrame:
    """One row (decided, deletes, hidden_deletes): rows with a decision and with delete among those shown, and deletes the filter hides."""
    shown = F.lit(True) if decision is None else F.coalesce("user_decision", F.lit("")) == decision
    delete, some = F.col("user_decision") == "delete", F.coalesce("user_decision", F.lit("")) != ""
    return rows.agg(F.count_if(some & shown).alias("decided"), F.count_if(delete & shown).alias("deletes"), F.count_if(delete & ~shown).alias("hidden_deletes"))


def delete_plan(rows: DataFrame, group: str = "group_id", selected: Column | None = None) -> DataFrame:
    """(group, total, selected, is_full_delete) of every group, also those of which nothing is selected; the default selects the rows decided as delete."""
    chosen = selected if selected is not None else F.col("user_decision") == "delete"
    sums = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(chosen).alias("selected"))
    return sums.withColumn("is_full_delete", (F.col("total") > 0) & (F.col("selected") == F.col("total")))


def complete_deletes(rows: DataFrame, group: str = "group_id", scope: DataFrame | None = None) -> DataFrame:
    """Groups in which every row is decided as delete; with a scope (source_path), every row of it, and at least one lies in it."""
    inside = rows if scope is None else rows.join(scope.select("source_path").distinct(), "source_path", "left_semi")
    return inside.where(F.col(group).isNotNull()).groupBy(group).agg(F.bool_and(F.coalesce("user_decision", F.lit("")) == "delete").alias("all_")).where("all_").select(group)


def known_paths(rows: DataFrame, paths: DataFrame, known: bool = True) -> DataFrame:
    """Rows whose path is among the paths (source_path), or is not."""
    return rows.join(paths.select("source_path").where("source_path is not null").distinct(), "source_path", "left_semi" if known else "left_anti")


def edge_bag(matches: DataFrame, a: str = "source_path", b: str = "duplicate_of") -> DataFrame:
    """(a, b) of every match in both directions, repeated ones as often as they are."""
    return matches.select(F.explode(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))).alias("e")).select("e.*")


def union_of_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """(source_path, origin) of all rows of several tables, repeated ones as often as they are."""
    parts = [df.select("source_path", F.lit(name).alias("origin")) for name, df in sources.items()]
    if not parts:
        raise ValueError("no sources")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """(source_path) in both, once each; NULL paths are in none."""
    return known_paths(a.select("source_path").where("source_path is not null").distinct(), b)


def provenance(rows: DataFrame, path: str = "source_path", label: str = "source_label") -> DataFrame:
    """(path, labels) of every path: the labels it was found under, sorted."""
    some = rows.where(F.col(path).isNotNull() & F.col(label).isNotNull())
    return some.groupBy(F.col(path).alias("path")).agg(F.sort_array(F.collect_set(label)).alias("labels"))


def single_rows(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """(source_path, kind) of groups of one row: locked, actioned (it has a decision), or plain."""
    ones = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source_path", "user_decision", "is_locked")).alias("r")).where("n = 1")
    kind = F.when(F.coalesce(F.col("r.is_locked").cast("int"), F.lit(0)) != 0, "locked").when(F.col("r.user_decision") != "", "actioned").otherwise("plain")
    return ones.select("r.source_path", kind.alias("kind"))


def group_of_path(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """Each path with its group_number, 0 if the manifest does not know it."""
    return paths.join(rows.select("source_path", "group_number"), "source_path", "left").withColumn("group_number", F.coalesce("group_number", F.lit(0)))


def without_paths(rows: DataFrame, removed: DataFrame, prune_singles: bool = False, group: str = "group_id") -> DataFrame:
    """Rows whose path is not among the removed; on request without groups that have a single row left."""
    left = rows.join(removed.select("source_path").distinct(), "source_path", "left_anti")
    return survivors(left, group) if prune_singles else left


def without_group(rows: DataFrame, number: object, group: str = "group_id") -> DataFrame:
    return rows.where(~F.col(group).eqNullSafe(F.lit(number)))
