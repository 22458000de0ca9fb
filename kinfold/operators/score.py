"""How worth keeping each member of a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent, stem, suffix

# Deductions by extension, weights of the dimensions, patterns and words that speak against a file.
FORMAT_PENALTY = {
    "nef": 0.00, "cr2": 0.00, "cr3": 0.00, "arw": 0.00, "dng": 0.00, "orf": 0.00, "rw2": 0.00, "raf": 0.00, "tiff": 0.05, "tif": 0.05,
    "heic": 0.10, "heif": 0.10, "png": 0.12, "webp": 0.18, "jpeg": 0.20, "jpg": 0.20, "mp4": 0.20, "mov": 0.20, "gif": 0.35,
}
OTHER_PENALTY, DERIVED_PENALTY = 0.20, 0.30
WEIGHTS = {
    "resolution": 0.25, "file_size": 0.05, "exif_complete": 0.20, "date_prov": 0.15, "gps": 0.08, "filename": 0.12, "path": 0.08, "live_photo": 0.07,
}
COPY_PATTERNS = (
    "(?i)(?<![A-Za-z])copy(?![A-Za-z])", r"\(\d+\)", "(?i)(?<![A-Za-z])edited?(?![A-Za-z])", "(?i)(?<![A-Za-z])thumb(?:nail)?(?![A-Za-z])",
    "(?i)(?<![A-Za-z])compressed(?![A-Za-z])", "(?i)(?<![A-Za-z])screenshot(?![A-Za-z])",
)
SIDELOAD_WORDS = ("downloads", "whatsapp", "screenshot", "recycle.bin", "trash", "temp", "tmp", "telegram", "instagram", "messenger")
VIDEO, HEIC = ("mov", "mp4", "avi"), ("heic", "heif")
IMAGE_TAGS, VIDEO_TAGS = 16, 9


def check_weights(weights: dict[str, float]) -> None:
    """ValueError if a weight is missing or they do not sum to 1 (to 0.001)."""
    missing = sorted(set(WEIGHTS) - set(weights))
    if missing:
        raise ValueError(f"weights are missing: {missing}")
    total = sum(weights[k] for k in WEIGHTS)
    if abs(total - 1.0) > 0.001:
        raise ValueError(f"weights sum to {total:.4f}, not 1")


def _between(value: Column, low: Column, high: Column) -> Column:
    """Place of a value between the group's extremes: 0 if it is missing or 0, 1 if the extremes are equal."""
    share = (value - low).cast("double") / F.when(high != low, high - low).cast("double")
    return F.when(F.coalesce(value, F.lit(0)) == 0, 0.0).when(low.isNull(), 0.0).when(low == high, 1.0).otherwise(share)


def dimensions(rows: DataFrame) -> DataFrame:
    """Adds d_<dimension> (each 0 to 1), format_penalty and passenger to manifest rows with a group_id.

    What is relative to the group comes from one aggregate per group, and one per group, stem and directory for
    pictures with a film beside them; both are partially aggregated before the shuffle and joined back, so no group is
    gathered in a task. Dates are ISO texts or timestamps; such as cannot be read count as unlike.
    """
    px = F.when((F.col("pixel_width") > 0) & (F.col("pixel_height") > 0), F.col("pixel_width").cast("bigint") * F.col("pixel_height"))
    size = F.when(F.col("file_size_bytes") > 0, F.col("file_size_bytes"))
    path = F.col("source_path")
    base = rows.withColumns({"_px": px, "_size": size, "_ext": suffix(path), "_stem": F.lower(stem(path)), "_dir": F.lower(parent(path))})
    ranges = base.groupBy("group_id").agg(
        F.min("_px").alias("_px_lo"), F.max("_px").alias("_px_hi"), F.min("_size").alias("_size_lo"), F.max("_size").alias("_size_hi")
    )
    heic, video = F.col("_ext").isin(*HEIC), F.col("_ext").isin(*VIDEO)
    peers = base.where(heic | video).groupBy("group_id", "_stem", "_dir").agg(F.max(heic).alias("_heic_peer"), F.max(video).alias("_video_peer"))
    joined = base.join(ranges, "group_id", "left").join(peers, ["group_id", "_stem", "_dir"], "left")
    hits = sum((F.regexp_like(stem(path), F.lit(p)).cast("int") for p in COPY_PATTERNS), F.lit(0))
    bad = F.lit("|".join(w.replace(".", r"\.") for w in SIDELOAD_WORDS))
    folders = F.size(F.filter(F.split("_dir", "/"), lambda s: F.regexp_like(s, bad)))
    shot, mtime = (F.col(c).try_cast("timestamp_ntz") for c in ("shot_date", "mtime"))
    near = F.abs(F.timestamp_diff("MICROSECOND", shot, mtime)) < 2_000_000
    penalty = F.create_map(*[F.lit(x) for kv in FORMAT_PENALTY.items() for x in kv])[F.col("_ext")]
    tags = F.when(video, F.lit(float(VIDEO_TAGS))).otherwise(F.lit(float(IMAGE_TAGS)))
    return joined.withColumns(
        {
            "d_resolution": _between(F.col("_px"), F.col("_px_lo"), F.col("_px_hi")),
            "d_file_size": _between(F.col("_size"), F.col("_size_lo"), F.col("_size_hi")),
            "d_exif_complete": F.when(F.col("exif_tag_count").isNull(), 0.0).otherwise(F.least(F.col("exif_tag_count") / tags, F.lit(1.0))),
            "d_date_prov": F.when(F.col("shot_date").isNull(), 0.0).when(F.coalesce(near, F.lit(False)), 0.3).otherwise(1.0),
            "d_gps": F.when(F.coalesce(F.col("gps_present").cast("int"), F.lit(0)) != 0, 1.0).otherwise(0.0),
            "d_filename": F.greatest(F.lit(0.0), 1.0 - 0.30 * hits),
            "d_path": F.greatest(F.lit(0.0), 1.0 - 0.25 * folders),
            "d_live_photo": F.when(heic & ~F.coalesce("_video_peer", F.lit(False)), 0.5).otherwise(1.0),
            "format_penalty": F.coalesce(penalty, F.lit(OTHER_PENALTY)),
            "passenger": video & F.coalesce("_heic_peer", F.lit(False)),
        }
    ).drop("_px", "_size", "_ext", "_stem", "_dir", "_px_lo", "_px_hi", "_size_lo", "_size_hi", "_heic_peer", "_video_peer")


def score_rows(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows with score computed anew: 0 to 1 for members of a group, NULL for rows of no group and films beside their picture.

    Rows that are out of review still count for the extremes of their group.
    """
    weights = weights or WEIGHTS
    check_weights(weights)
    grouped = dimensions(rows.where(F.col("group_id").isNotNull()).drop("score"))
    total = F.lit(weights["resolution"]) * F.col("d_resolution")
    for k in list(WEIGHTS)[1:]:
        total = total + F.lit(weights[k]) * F.col(f"d_{k}")
    derived = F.when(F.coalesce(F.col("xmp_derived").cast("int"), F.lit(0)) != 0, DERIVED_PENALTY).otherwise(0.0)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total - F.col("format_penalty") - derived))
    scored = grouped.withColumn("score", F.when(~F.col("passenger"), value)).drop("format_penalty", "passenger", *[f"d_{k}" for k in WEIGHTS])
    alone = rows.where(F.col("group_id").isNull()).withColumn("score", F.lit(None).cast("double"))
    return scored.unionByName(alone).select(*[c for c in rows.columns if c != "score"], "score")
