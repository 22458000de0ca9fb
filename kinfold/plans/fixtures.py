"""Inputs of the core queries, derived from the test tables; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import digest
from ..functions.paths import file_type
from ..operators.instants import manifest_instants
from ..runtime import Scratch, table

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """migration_manifest with impossible numbers cleared and only dates in ISO notation kept."""
    m = table(spark, d, "migration_manifest")
    iso = lambda c: F.when(F.col(c).rlike(_ISO), F.col(c).try_cast("timestamp_ntz")).alias(c)
    above = lambda c, least: F.when(F.col(c) >= least, F.col(c)).alias(c)
    cols = {
        "score": F.when(~F.isnan("score") & F.col("score").between(0, 1), F.col("score")).alias("score"), "file_size_bytes": above("file_size_bytes", 1),
        "exif_tag_count": above("exif_tag_count", 0), "group_id": F.when(F.col("group_id") != "", F.col("group_id")).alias("group_id"),
        "shot_date": iso("shot_date"), "creation_date": iso("creation_date"), "mtime": iso("mtime"),
    }
    return m.select(*[cols.get(c, F.col(c)) for c in m.columns])


MANIFEST_SQL = f"""manifest AS (
  SELECT * REPLACE (
    CASE WHEN NOT isnan(score) AND score BETWEEN 0 AND 1 THEN score END AS score, CASE WHEN file_size_bytes >= 1 THEN file_size_bytes END AS file_size_bytes,
    CASE WHEN exif_tag_count >= 0 THEN exif_tag_count END AS exif_tag_count, CASE WHEN group_id <> '' THEN group_id END AS group_id,
    CASE WHEN regexp_matches(shot_date, '{_ISO}') THEN TRY_CAST(shot_date AS TIMESTAMP) END AS shot_date,
    CASE WHEN regexp_matches(creation_date, '{_ISO}') THEN TRY_CAST(creation_date AS TIMESTAMP) END AS creation_date,
    CASE WHEN regexp_matches(mtime, '{_ISO}') THEN TRY_CAST(mtime AS TIMESTAMP) END AS mtime)
  FROM migration_manifest)"""


def dated_manifest(spark: SparkSession, d: str) -> DataFrame:
    """manifest() with its three dates read in whatever notation they have, as `p3_found` does; in UTC. SQL has no counterpart."""
    m = table(spark, d, "migration_manifest")
    none = spark.createDataFrame([], "sidecar_id bigint, source_label string, raw string")
    read = manifest_instants(m, none, table(spark, d, "scan_source"))
    dates = ("shot_date", "creation_date", "mtime")
    at = lambda c: F.timestamp_micros(F.min(F.when(F.col("field") == c, F.col("epoch_us")))).cast("timestamp_ntz").alias(c)
    found = Scratch(spark, "dated").keep(read.groupBy(F.col("rec_id").alias("id")).agg(*[at(c) for c in dates]))
    return manifest(spark, d).drop(*dates).join(found, "id", "left").select(*m.columns)


def media(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints: the first delivery of every path, with a second hash and a colour made from what is there."""
    m = table(spark, d, "migration_manifest").where("source_path is not null")
    first = m.groupBy("source_path").agg(F.min(F.struct("id", "source_label", "source_hash", "phash", "pixel_width", "pixel_height", "file_size_bytes")).alias("r"))
    r = first.select("source_path", "r.*")
    p = F.regexp_extract(F.lower("phash"), r"^\s*(?:0x)?([0-9a-f]{16})\s*$", 1)
    r = r.withColumns({"p": F.when(p != "", p), "s": F.coalesce(digest(F.col("source_hash")), F.concat(F.lit("none-"), F.col("id").cast("string")))})
    i = F.col("id")
    return r.select(
        i.alias("ord"), F.col("source_path").alias("path"), F.lower(F.trim("source_label")).alias("source_label"), file_type(F.col("source_path")).alias("file_type"),
        F.col("s").alias("sha256"), F.col("p").alias("phash"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, F.substring("s", 1, 16)).otherwise(F.reverse("p")).alias("dhash"),
        F.when(i % 11 != 0, F.concat_ws(",", (F.coalesce("pixel_width", F.lit(0)) % 50).cast("string"), (i % 20).cast("string"), (i % 17).cast("string"))).alias("mean_color"),
        "pixel_width", "pixel_height", "file_size_bytes", F.when(i % 7 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("exif_date"),
    )


def dated_media(spark: SparkSession, d: str) -> DataFrame:
    """media() with the dates, tag count and flags its delivery has in the manifest; exif_date is the shot date. SQL has no counterpart."""
    real = dated_manifest(spark, d).select(F.col("id").alias("ord"), F.col("shot_date").alias("exif_date"), "mtime", "exif_tag_count", "gps_present", "xmp_derived")
    return media(spark, d).drop("exif_date").join(real, "ord")


MEDIA_SQL = r"""media AS (
  SELECT id AS ord, source_path AS path, lower(trim(source_label)) AS source_label,
    CASE WHEN ext IN ('jpg', 'jpeg') THEN 'jpeg' WHEN ext IN ('heic', 'heif') THEN 'heic' WHEN ext IN ('png', 'gif', 'webp', 'mov') THEN ext
      WHEN ext IN ('tif', 'tiff', 'dng', 'cr2', 'cr3', 'nef', 'arw', 'raf', 'rw2') THEN 'raw' WHEN ext IN ('mp4', 'm4v', 'avi') THEN 'mp4' ELSE 'skip' END AS file_type,
    s AS sha256, p AS phash, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN substr(s, 1, 16) ELSE reverse(p) END AS dhash,
    CASE WHEN id % 11 <> 0 THEN concat_ws(',', coalesce(pixel_width, 0) % 50, id % 20, id % 17) END AS mean_color, pixel_width, pixel_height, file_size_bytes,
    CASE WHEN id % 7 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS exif_date,
    CASE WHEN p IS NOT NULL THEN CAST('0x' || p AS UBIGINT) END AS h
  FROM (
    SELECT *, lower(regexp_extract(source_path, '\.([^./]+)$', 1)) AS ext, nullif(regexp_extract(lower(phash), '^\s*(?:0x)?([0-9a-f]{16})\s*$', 1), '') AS p,
      coalesce(nullif(regexp_extract(lower(source_hash), '^\s*(?:sha-?256\s*[:=]?\s*)?([0-9a-f]{64})\s*$', 1), ''), 'none-' || id) AS s
    FROM migration_manifest WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY id) = 1)
), ranked AS (
  SELECT media.*, coalesce(prio, 2147483647) AS prio FROM media LEFT JOIN (
    SELECT source_label, row_number() OVER (ORDER BY min(ord)) - 1 AS prio FROM media WHERE source_label IS NOT NULL GROUP BY 1) USING (source_label)
)"""

#: The classification passes in SQL, on top of `ranked`.
CLASSIFY_SQL = r"""exact AS (
  SELECT ord, keeper FROM (SELECT ord, first_value(path) OVER w AS keeper, row_number() OVER w AS n FROM ranked WINDOW w AS (PARTITION BY sha256 ORDER BY prio, ord)) WHERE n > 1
), cand AS (
  SELECT * FROM ranked WHERE h IS NOT NULL AND bit_count(h) BETWEEN 4 AND 60 AND (pixel_width IS NULL OR pixel_height IS NULL OR (pixel_width >= 128 AND pixel_height >= 128))
    AND ord NOT IN (SELECT ord FROM exact)
), lossy AS (
  SELECT *, CASE file_type WHEN 'heic' THEN 0 WHEN 'jpeg' THEN 1 WHEN 'png' THEN 2 WHEN 'gif' THEN 3 ELSE 4 END AS rk FROM cand
  WHERE file_type IN ('heic', 'jpeg', 'png', 'gif', 'webp')
    AND phash IN (SELECT phash FROM cand GROUP BY 1 HAVING count_if(file_type = 'raw') = 0 AND count_if(file_type IN ('heic', 'jpeg', 'png', 'gif', 'webp')) >= 2)
), versus AS (
  SELECT *, row_number() OVER w AS n, first_value(path) OVER w AS keeper, first_value(file_type) OVER w AS keeper_type, first_value(dhash) OVER w AS kd, first_value(mean_color) OVER w AS kc
  FROM lossy WINDOW w AS (PARTITION BY phash ORDER BY rk, prio, ord)
), formats AS (
  SELECT ord, keeper, keeper_type, vote FROM (SELECT *, VOTE(dhash, kd) AS vote FROM versus WHERE n > 1) WHERE vote <> 'disagree' AND COLOUR(mean_color, kc)
), open AS (SELECT * FROM cand WHERE ord NOT IN (SELECT ord FROM formats)
), pairs AS (
  SELECT * FROM (
    SELECT a.ord AS i, b.ord AS j, bit_count(xor(a.h, b.h)) AS bits, VOTE(a.dhash, b.dhash) AS vote, a.prio AS prio_i, b.prio AS prio_j, a.path AS path_i, b.path AS path_j,
      a.mean_color AS ca, b.mean_color AS cb
    FROM open a JOIN open b ON a.ord < b.ord AND bit_count(xor(a.h, b.h)) BETWEEN 1 AND 10)
  WHERE vote <> 'disagree' AND COLOUR(ca, cb)
), earlier AS (
  SELECT j AS ord, min(i) AS i FROM pairs WHERE prio_i <= prio_j GROUP BY 1
), later AS (
  SELECT p.i AS ord, min(p.j) AS j FROM pairs p LEFT JOIN earlier e ON e.ord = p.j WHERE p.prio_i > p.prio_j AND (e.i IS NULL OR e.i >= p.i) GROUP BY 1
), near AS (
  SELECT e.ord, p.path_i AS keeper, p.bits, p.vote FROM earlier e JOIN pairs p ON p.j = e.ord AND p.i = e.i
  UNION ALL
  SELECT l.ord, p.path_j, p.bits, p.vote FROM later l JOIN pairs p ON p.i = l.ord AND p.j = l.j WHERE l.ord NOT IN (SELECT ord FROM earlier)
)"""


def _expand(sql: str) -> str:
    """Spells out VOTE(a, b) and COLOUR(a, b)."""
    import re

    ok = r"regexp_matches({0}, '^[0-9a-fA-F]{{16}}$')"
    bits = "bit_count(xor(CAST('0x' || {0} AS UBIGINT), CAST('0x' || {1} AS UBIGINT)))"
    vote = (
        "CASE WHEN NOT coalesce(" + ok + ", false) OR NOT coalesce(" + ok.replace("{0}", "{1}") + ", false) THEN 'unknown' WHEN " + bits + " <= 10 THEN 'agree' ELSE 'disagree' END"
    )
    part = "CAST(split_part({0}, ',', N) AS DOUBLE) - CAST(split_part({1}, ',', N) AS DOUBLE)"
    square = " + ".join(f"({part.replace('N', str(n))}) * ({part.replace('N', str(n))})" for n in (1, 2, 3))
    colour = "coalesce(sqrt(" + square + ") <= 30, true)"
    args = r"\(([\w.]+), ([\w.]+)\)"
    sql = re.sub("VOTE" + args, lambda m: vote.format(m[1], m[2]), sql)
    return re.sub("COLOUR" + args, lambda m: colour.format(m[1], m[2]), sql)


CLASSIFY_SQL = _expand(CLASSIFY_SQL)
