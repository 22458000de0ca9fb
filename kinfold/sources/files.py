"""Directories of media files as DataFrames."""

from __future__ import annotations

import hashlib
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import file_type, has_unsafe_name, in_skipped_directory, is_media, is_skipped_name, magic_type
from ..runtime import Scratch


def through_link(path: Column, root: str) -> Column:
    """Whether a file, or a directory between it and the root, is a symbolic link; a root that is one does not count.

    Asks the file system the workers see, once a directory and batch.
    """
    base = re.sub("^file:/+", "/", root).rstrip("/") + "/"

    @F.pandas_udf(T.BooleanType())
    def linked(paths: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def has(p: str) -> bool:
            if len(p) < len(base):
                return False
            if p not in known:
                known[p] = os.path.islink(p) or has(os.path.dirname(p))
            return known[p]

        return paths.map(lambda p: p.startswith(base) and (os.path.islink(p) or has(os.path.dirname(p))))

    return linked(path)


def scan_sources(
    spark: SparkSession,
    sources: dict[str, str],
    recursive: dict[str, bool] | None = None,
    limit: int | None = None,
    media_only: bool = True,
    content: bool = False,
) -> DataFrame:
    """(ord, path, source_label, size, modified, unsafe_name, file_type[, content]) of the files under each root, sources in their order.

    A missing root raises an error (of the file system); files that vanish while scanning are skipped, and with content those that cannot
    be read (see `read_stage` for a way that keeps them). Directories and files of the skip lists are left out, and what is reached through
    a symbolic link below the root. `limit` is per source, by path. ord numbers the files from 0: by source, then path; the listing is
    sorted and written for that, not the content, which is only read when asked for.
    """
    parts = []
    for rank, (label, root) in enumerate(sources.items()):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str((recursive or {}).get(label, True)).lower())
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        path = F.regexp_replace("path", "^file:/+", "/")
        base = root.rstrip("/") + "/"
        files = reader.load(root).select(
            path.alias("path"), F.lit(label).alias("source_label"), F.lit(rank).alias("rank"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
            *(["content"] if content else []),
        )
        kept = files.where(~is_skipped_name(F.col("path")) & ~in_skipped_directory(F.col("path"), base))
        kept = kept.where(is_media(F.col("path"))) if media_only else kept
        kept = kept.where(~through_link(F.col("path"), root))
        parts.append(kept.orderBy("path").limit(limit) if limit is not None else kept)
    if not parts:
        raise ValueError("no sources")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = in_order(out.select("rank", "path"), ["rank", "path"])
    kind = _resolved_type() if content else file_type(F.col("path"))
    out = out.join(order, ["rank", "path"]).drop("rank")
    return out.select("ord", *[c for c in out.columns if c != "ord"], has_unsafe_name(F.col("path")).alias("unsafe_name"), kind.alias("file_type"))


def in_order(rows: DataFrame, by: list[str], name: str = "ord") -> DataFrame:
    """The rows numbered from 0 in order of some columns: a range sort, and the counts of earlier parts, one a part."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    laid = Scratch(spark, "order").keep(laid)
    part = F.shiftright("_id", 33).alias("_part")
    sizes = laid.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row a part of the sort.
    numbered = laid.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part")
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def _resolved_type():
    """The extension's kind, overridden by the content for kinds whose extension is often wrong."""
    named, seen = file_type(F.col("path")), magic_type(F.col("content"))
    return F.when(named.isin("heic", "raw", "png", "gif", "webp") & seen.isNotNull(), seen).otherwise(named)


def read_stage(files: DataFrame) -> DataFrame:
    """Adds sha256 of the content and error, NULL where it was read; drops the content if there is one.

    Without a content column the workers read the files themselves, a piece at a time, so films of any size pass and a file that cannot
    be read comes out with the error's name and message instead of a digest; the first bytes then settle file_type where extensions
    are often wrong. Paths must be those of a file system that all workers see.
    """
    if "content" in files.columns:
        return files.withColumns({"sha256": F.sha2("content", 256), "error": F.lit(None).cast("string")}).drop("content")
    read = files.withColumn("_read", _digest_of("path"))
    known = read.withColumns({"sha256": F.col("_read.sha256"), "error": F.col("_read.error"), "content": F.col("_read.head")})
    return known.withColumn("file_type", _resolved_type()).select(*files.columns, "sha256", "error")


@F.pandas_udf(T.StructType().add("sha256", T.StringType()).add("head", T.BinaryType()).add("error", T.StringType()))
def _digest_of(paths: pd.Series) -> pd.DataFrame:
    """Digest and first bytes of each file, or why it cannot be read."""
    out = []
    for path in paths:
        digest, head = hashlib.sha256(), b""
        try:
            with open(path, "rb") as f:
                while piece := f.read(1 << 20):
                    head = head or piece[:12]
                    digest.update(piece)
            out.append((digest.hexdigest(), head, None))
        except (OSError, TypeError) as e:
            out.append((None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["sha256", "head", "error"])


def split_read(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read, unread): rows of the read stage without and with an error."""
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def media_records(read: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows that `classify` takes: scanned and read files with what an image library says of them, by path.

    hashes: path, and any of phash, dhash, mean_color, pixel_width, pixel_height, exif_date; what is absent is NULL.
    """
    kinds = {"phash": "string", "dhash": "string", "mean_color": "string", "pixel_width": "int", "pixel_height": "int", "exif_date": "timestamp_ntz"}
    given = hashes.select("path", *[F.col(c) if c in hashes.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    return read.join(given, "path", "left")


def split_decoded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): pictures of kinds that must decode but have no perceptual hash are rejected."""
    failed = F.col("file_type").isin("jpeg", "heic", "png", "webp") & F.col("phash").isNull()
    return rows.where(~failed), rows.where(failed).withColumn("error", F.lit("not decoded"))
