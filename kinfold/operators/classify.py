"""Exact, format and near duplicates of a fingerprint table, and the groups they form.

Rows: ord BIGINT (the input order, unique), path (unique), source_label, file_type, sha256, phash, dhash, mean_color,
pixel_width, pixel_height, exif_date. '' counts as absent for phash, dhash and mean_color.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import bits_apart
from ..functions.labels import colour_distance, hamming, hex_hash
from ..functions.paths import basename, parent, stem, stem_parts
from ..runtime import Scratch
from .components import components
from .similarity import hash_value_pairs, similar_pairs

# Order in which formats are preferred as the kept one of equal pictures.
FORMAT_RANK = {"heic": 0, "jpeg": 1, "png": 2, "gif": 3, "webp": 4}


@dataclass(frozen=True)
class Thresholds:
    """0 or less turns a gate off (hamming: 0 finds no near duplicates)."""

    hamming: int = 10
    mean_color: float = 30.0
    entropy_bits: int = 4
    dhash: int = 10
    min_side: int = 128


def entropy_ok(phash: Column, min_bits: int) -> Column:
    """Whether the hash has at least min_bits bits set and as many unset, by its own length; true if it cannot be read."""
    if min_bits <= 0:
        return F.lit(True)
    value = F.when(phash.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(phash, 16, -10).cast("bigint"))
    return F.coalesce(F.bit_count(value).between(F.lit(min_bits), F.length(phash) * 4 - min_bits), F.lit(True))


def side_ok(width: Column, height: Column, least: int) -> Column:
    """Whether both sides have at least that many pixels; true if one is unknown."""
    return F.lit(True) if least <= 0 else width.isNull() | height.isNull() | ((width >= least) & (height >= least))


def colour_ok(a: Column, b: Column, most: float) -> Column:
    return F.lit(True) if most <= 0 else F.coalesce(colour_distance(a, b) <= most, F.lit(True))


def dhash_vote(a: Column, b: Column, most: int) -> Column:
    """'agree', 'disagree', or 'unknown' if one of the hashes cannot be read."""
    return _vote(hamming(a, b), most)


def _vote(d: Column, most: int) -> Column:
    return F.when(d.isNull(), "unknown").when(d <= most, "agree").otherwise("disagree")


def source_priority(rows: DataFrame, given: dict[str, int] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Adds prio: the given rank of the label (unlisted: after all), or the rank in order of first appearance.

    The ranks go through `keep`, which may write them, so that they are found once for all uses of the rows.
    """
    if given is not None:
        ranks = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(v))]) if given else None
        return rows.withColumn("prio", F.coalesce(ranks[F.col("source_label")] if given else F.lit(None).cast("int"), F.lit(len(given))))
    # One row a label: the window over them is as small as their number.
    first = rows.where("source_label is not null").groupBy("source_label").agg(F.min("ord").alias("first"))
    ranked = keep(first.select("source_label", (F.row_number().over(Window.orderBy("first")) - 1).alias("prio")))
    return rows.join(ranked, "source_label", "left").withColumn("prio", F.coalesce("prio", F.lit(2**31 - 1)))


def candidates(rows: DataFrame, t: Thresholds) -> Column:
    """Whether a row's perceptual hash may be compared: present, textured, of a large enough picture."""
    return (
        F.coalesce(F.col("phash") != "", F.lit(False)) & entropy_ok(F.col("phash"), t.entropy_bits) & side_ok(F.col("pixel_width"), F.col("pixel_height"), t.min_side)
    )


def exact_copies(rows: DataFrame, name: str = "path") -> DataFrame:
    """(ord, keeper): of each content hash, every row but the first by priority and order, with the first one's path, or its other column `name`.

    The first is found by a minimum that is aggregated before the shuffle; rows are joined back by hash.
    """
    keeper = rows.where("sha256 is not null").groupBy("sha256").agg(F.min(F.struct("prio", "ord", F.col(name).alias("name"))).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(keeper, "sha256").where(F.col("ord") != F.col("k.ord")).select("ord", F.col("k.name").alias("keeper"))


def format_copies(rows: DataFrame, t: Thresholds, name: str = "path") -> DataFrame:
    """(ord, keeper, keeper_type, vote) of rows with the perceptual hash of a better one, known by its column `name`, in another format or place.

    Groups with a raw file beside lossy ones, or with fewer than two lossy ones, are left alone. The keeper is the
    first by format, priority and order; others must pass the colour gate and not be voted down against it.
    """
    lossy = F.col("file_type").isin(*FORMAT_RANK)
    rank = F.create_map(*[F.lit(x) for kv in FORMAT_RANK.items() for x in kv])[F.col("file_type")]
    best = F.struct(F.coalesce(rank, F.lit(99)).alias("rank"), "prio", "ord", F.col(name).alias("name"), "file_type", "mean_color", "dhash")
    groups = (
        rows.groupBy("phash")
        .agg(F.max((F.col("file_type") == "raw").cast("int")).alias("raw"), F.count_if(lossy).alias("lossy"), F.min(F.when(lossy, best)).alias("k"))
        .where((F.col("lossy") >= 2) & (F.col("raw") == 0))
    )
    vote = dhash_vote(F.col("dhash"), F.col("k.dhash"), t.dhash)
    return (
        rows.where(lossy)
        .join(groups, "phash")
        .where(F.col("ord") != F.col("k.ord"))
        .withColumn("vote", vote)
        .where((F.col("vote") != "disagree") & colour_ok(F.col("mean_color"), F.col("k.mean_color"), t.mean_color))
        .select("ord", F.col("k.name").alias("keeper"), F.col("k.file_type").alias("keeper_type"), "vote")
    )


def gated_pairs(rows: DataFrame, t: Thresholds, strategy: str = "index") -> DataFrame:
    """(i, j, bits, vote, prio_i, prio_j) of candidate pairs within the threshold that pass colour and vote."""
    read = rows.select("ord", "phash", "prio", "mean_color", hex_hash(F.col("dhash")).alias("d"))
    pairs = similar_pairs(read, t.hamming, hex_hash(F.col("phash")), "ord", strategy, ["prio", "mean_color", "d"])
    kept = pairs.withColumn("vote", _vote(bits_apart(F.col("d_i"), F.col("d_j")), t.dhash))
    gate = (F.col("vote") != "disagree") & colour_ok(F.col("mean_color_i"), F.col("mean_color_j"), t.mean_color)
    return kept.where(gate).select("i", "j", "bits", "vote", "prio_i", "prio_j")


def near_pairs(rows: DataFrame, t: Thresholds, strategy: str = "index") -> DataFrame:
    """`gated_pairs` with path_i and path_j, which are joined last: the pairs meet without them."""
    path = lambda s: rows.select(F.col("ord").alias(s), F.col("path").alias(f"path_{s}"))
    return gated_pairs(rows, t, strategy).join(path("i"), "i").join(path("j"), "j").select("i", "j", "bits", "vote", "prio_i", "prio_j", "path_i", "path_j")


def near_copies(pairs: DataFrame) -> DataFrame:
    """(ord, keeper, bits, vote): which row of near pairs is a duplicate of which, as if pairs were taken in order.

    A row is a duplicate of the first earlier row that has no lower priority; failing that, of the first later row of
    better priority that itself is no duplicate of a row before this one.
    """
    earlier = pairs.where("prio_i <= prio_j").groupBy(F.col("j").alias("ord")).agg(F.min(F.struct("i", "path_i", "bits", "vote")).alias("b"))
    taken = earlier.select(F.col("ord").alias("j"), F.col("b.i").alias("taken"))
    later = (
        pairs.where("prio_i > prio_j")
        .join(taken, "j", "left")
        .where("taken is null or taken >= i")
        .groupBy(F.col("i").alias("ord"))
        .agg(F.min(F.struct("j", "path_j", "bits", "vote")).alias("r"))
    )
    both = earlier.join(later, "ord", "full")
    pick = lambda a, b: F.when(F.col("b").isNotNull(), F.col(f"b.{a}")).otherwise(F.col(f"r.{b}"))
    return both.select("ord", pick("path_i", "path_j").alias("keeper"), pick("bits", "bits").alias("bits"), pick("vote", "vote").alias("vote"))


def near_classes(rows: DataFrame, t: Thresholds, strategy: str = "index", names: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, links): near duplicates by classes, so that rows of two close hashes never all meet.

    A class is the rows of one hash, priority, colour and second hash: all that the gates look at. members is (ord, first, and path with
    names): every row with the ord of its class's first row. links is (a, a_prio, b, b_prio, bits, vote), in both directions, of the classes
    whose rows are near duplicates, known by the ord of their first rows. Paths aren't carried along: there are more links than rows.
    """
    kind = ["h", "prio", "mean_color", "d"]
    scratch = Scratch(rows.sparkSession, "near", "zstd")
    held = scratch.keep(
        rows.select("ord", *["path"] * names, "prio", "mean_color", hex_hash(F.col("dhash")).alias("d"), hex_hash(F.col("phash")).alias("h")).where("h is not null")
    )
    classes = scratch.keep(held.groupBy(*kind).agg(F.min("ord").alias("first")))
    same = [held[c].eqNullSafe(classes[c]) for c in kind]
    members = scratch.keep(held.join(classes, same[0] & same[1] & same[2] & same[3]).select("ord", *["path"] * names, "first"))
    scratch.drop(held)
    scratch.settle()
    pairs = hash_value_pairs(classes.select("h").distinct(), t.hamming, strategy).where("bits > 0")
    side = lambda s: classes.select(F.col("h").alias("a" if s == "i" else "b"), *[F.col(c).alias(f"{c}_{s}") for c in ("first", "prio", "mean_color", "d")])
    met = pairs.join(side("i"), "a").join(side("j"), "b").withColumn("vote", _vote(bits_apart(F.col("d_i"), F.col("d_j")), t.dhash))
    met = met.where((F.col("vote") != "disagree") & colour_ok(F.col("mean_color_i"), F.col("mean_color_j"), t.mean_color))
    met = scratch.keep(met.select("first_i", "prio_i", "first_j", "prio_j", F.col("bits").cast("int").alias("bits"), "vote"))
    scratch.drop(classes)
    scratch.settle()
    one = lambda i, j: met.select(F.col(f"first_{i}").alias("a"), F.col(f"prio_{i}").alias("a_prio"), F.col(f"first_{j}").alias("b"), F.col(f"prio_{j}").alias("b_prio"), "bits", "vote")
    return members, one("i", "j").unionByName(one("j", "i"))


def _keepers_of_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(ord, keeper, bits, vote) as `near_copies` gives it, from classes; keeper is an ord.

    Of an earlier class only the first row can be the first earlier row of another, so a class has one candidate for all its rows. A row
    without an earlier one comes before the first rows of all close classes of no lower priority, so of a later class, too, only the
    first row counts, and it is no duplicate of a row before this one if its class's own candidate comes after this one.
    """
    head = links.where("a_prio <= b_prio").groupBy(F.col("b").alias("first")).agg(F.min(F.struct("a", "bits", "vote")).alias("e"))
    placed = members.select("ord", "first").join(head, "first", "left").withColumn("e", F.when(F.col("e.a") < F.col("ord"), F.col("e")))
    taken = head.select(F.col("first").alias("b"), F.col("e.a").alias("taken"))
    after = links.where("b_prio < a_prio").join(taken, "b", "left").select(F.col("a").alias("first"), "b", "bits", "vote", "taken")
    later = placed.where("e is null").select("ord", "first").join(after, "first").where("taken is null or taken >= ord")
    later = later.groupBy("ord").agg(F.min(F.struct("b", "bits", "vote")).alias("l"))
    both = placed.join(later, "ord", "left").where("e is not null or l is not null")
    pick = lambda a, b: F.when(F.col("e").isNotNull(), F.col(f"e.{a}")).otherwise(F.col(f"l.{b}"))
    return both.select("ord", pick("a", "b").alias("keeper"), pick("bits", "bits").alias("bits"), pick("vote", "vote").alias("vote"))


def near_copies_of_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(ord, keeper, bits, vote) as `near_copies` gives it, from classes (see `_keepers_of_classes`), with the keeper's path."""
    path = members.select(F.col("ord").alias("k"), "path")
    return _keepers_of_classes(members, links).withColumnRenamed("keeper", "k").join(path, "k").select("ord", F.col("path").alias("keeper"), "bits", "vote")


def _edges_of_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst), ords: edges that connect what near pairs of rows connect: the first rows of close classes, and every row with the first row of one class close to its own."""
    one = links.groupBy(F.col("a").alias("first")).agg(F.min("b").alias("dst"))
    return links.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(members.join(one, "first").select(F.col("ord").alias("src"), "dst"))


def near_edges(members: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): the paths of `_edges_of_classes`."""
    path = lambda s: members.select(F.col("ord").alias(s[0]), F.col("path").alias(s))
    ends = _edges_of_classes(members, links).toDF("s", "d")
    return ends.join(path("src"), "s").join(path("dst"), "d").select("src", "dst")


def stem_pairs(rows: DataFrame, t: Thresholds, name: str = "path") -> DataFrame:
    """(src, dst), by path or another unique column: files of one directory with the same name but for the extension, and the same copy number; not of edited ones.

    Left out if both have a hash and these are further apart than the threshold.
    """
    parts = stem_parts(F.col("whole"))
    cut = F.struct("dir", parts["base_stem"].alias("s"), F.coalesce(parts["number"], F.lit(-1)).alias("n"), parts["is_edited"].alias("edited"))
    named = rows.select(F.col(name).alias("src"), hex_hash(F.col("phash")).alias("p"), parent(F.col("path")).alias("dir"), stem(F.col("path")).alias("whole"))
    # As the only element of an array, what was cut is there once; filters and join keys would else be moved down and cut names again. Unedited names are clean.
    a = named.select("src", "p", F.explode(F.array(cut)).alias("cut")).select("src", "p", "cut.*").where("not edited").drop("edited")
    b = a.withColumnsRenamed({"src": "dst", "p": "q"})
    met = a.join(b, ["dir", "s", "n"]).where("src < dst")
    return met.where(F.coalesce(bits_apart(F.col("p"), F.col("q")) <= t.hamming, F.lit(True))).select("src", "dst")


def pair_clusters(rows: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """(path, cluster) of files paired by their names (see `stem_pairs`), such as a raw picture, its developed one and its film: cluster is the smallest path of them."""
    return components(stem_pairs(rows, t or Thresholds())).select(F.col("node").alias("path"), F.col("component").alias("cluster"))


def passes(media: DataFrame, t: Thresholds, priority: dict[str, int] | None = None, strategy: str = "index", groups: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, labels, linked): the media rows with prio; (ord, keeper, action, bits, conf, why) of those that a pass labels, keeper an ord; (ord,
    component) of those linked by a label, a near pair or a common stem, None if groups is false. See `classify`. No paths are carried along.
    """
    scratch = Scratch(media.sparkSession, "classify", "zstd")
    rows = source_priority(scratch.keep(media), priority, scratch.keep)
    scratch.settle()
    exact = scratch.keep(exact_copies(rows, "ord"))
    open_rows = rows.join(exact.select("ord"), "ord", "left_anti").where(candidates(rows, t))
    open_rows = scratch.keep(open_rows.select("ord", "prio", "file_type", "phash", "dhash", "mean_color"))
    formats = scratch.keep(format_copies(open_rows, t, "ord"))
    scratch.settle()
    members, links = near_classes(open_rows.join(formats.select("ord"), "ord", "left_anti"), t, strategy, names=False)
    scratch.drop(open_rows)
    near = _keepers_of_classes(members, links)
    labels = scratch.keep(
        exact.select("ord", "keeper", F.lit("EXACT").alias("action"), F.lit(None).cast("int").alias("bits"), F.lit("high").alias("conf"), F.lit("exact").alias("why"))
        .unionByName(
            formats.select(
                "ord", "keeper", F.lit("EXACT").alias("action"), F.lit(0).alias("bits"), F.when(F.col("vote") == "agree", "high").otherwise("low").alias("conf"),
                F.col("keeper_type").alias("why"),
            )
        )
        .unionByName(
            near.select(
                "ord", "keeper", F.lit("REVIEW_DUPLICATE").alias("action"), F.col("bits").cast("int").alias("bits"),
                F.when(F.col("vote") == "agree", "high").otherwise("low").alias("conf"), F.lit("near").alias("why"),
            )
        )
    )
    scratch.drop(exact)
    scratch.drop(formats)
    scratch.settle()
    if not groups:
        return rows, labels, None
    edges = labels.select(F.col("ord").alias("src"), F.col("keeper").alias("dst")).unionByName(_edges_of_classes(members, links)).unionByName(stem_pairs(rows, t, "ord"))
    return rows, labels, components(edges).select(F.col("node").alias("ord"), "component")


def group_names(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(component, group_id): the smallest path of each component."""
    return linked.join(rows.select("ord", "path"), "ord").groupBy("component").agg(F.min("path").alias("group_id"))


def duplicate_groups(media: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """(path, group_id) of the rows that `classify` links to others."""
    rows, _, linked = passes(media, t or Thresholds())
    return linked.join(group_names(rows, linked), "component").join(rows.select("ord", "path"), "ord").select("path", "group_id")


def said_of(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels with the keeper's path in place of its ord."""
    path = rows.select(F.col("ord").alias("k"), F.col("path").alias("keeper"))
    return labels.withColumnRenamed("keeper", "k").join(path, "k").drop("k")


def action() -> Column:
    """What `classify` says of a row joined with its label."""
    return F.coalesce("action", F.when(F.col("exif_date").isNull(), "UNDATED").otherwise(""))


def reason() -> Column:
    """The text of `action`, with the keeper by its name."""
    name = basename(F.col("keeper"))
    return (
        F.when(F.col("why") == "exact", F.concat(F.lit("exact duplicate of "), name))
        .when(F.col("why") == "near", F.format_string("near-duplicate (hamming=%d) of %s", F.col("bits"), name))
        .when(F.col("why").isNotNull(), F.concat(F.lit("format duplicate of "), name, F.lit(" ("), F.col("file_type"), F.lit(" vs "), F.col("why"), F.lit(")")))
        .when(F.col("exif_date").isNull(), "no EXIF DateTimeOriginal")
        .otherwise("unique")
    )


def classify(media: DataFrame, t: Thresholds | None = None, priority: dict[str, int] | None = None, strategy: str = "index", groups: bool = True) -> DataFrame:
    """The media rows with action, duplicate_of, hamming_distance, match_confidence, reason and group_id.

    Passes in this order, the first that labels a row wins: EXACT by content, EXACT by format (equal perceptual hash),
    REVIEW_DUPLICATE by near hash, UNDATED without a date, else ''. group_id is the smallest path of the rows linked by
    any of these labels, by a near pair, or by a common stem; NULL for rows linked to none; left out if groups is false.

    Rows without sha256 are no exact copies. ord and path must be unique. An empty input gives no rows. Between the passes
    rows are known by ord; paths are joined once at the end.
    """
    rows, labels, linked = passes(media, t or Thresholds(), priority, strategy, groups)
    said = said_of(rows, labels)
    if groups:
        # Whatever has a label is linked to its keeper.
        said = linked.join(group_names(rows, linked), "component").select("ord", "group_id").join(said, "ord", "left")
    return (
        rows.join(said, "ord", "left")
        .select(
            *media.columns,
            action().alias("action"),
            F.col("keeper").alias("duplicate_of"),
            F.col("bits").alias("hamming_distance"),
            F.col("conf").alias("match_confidence"),
            reason().alias("reason"),
            *["group_id"] * groups,
        )
    )
