"""Metadata of files as a tool reports it: JSON records, dates, tag counts, and the merging of several tools' findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import exif_date, rating

# Tags that hold the date (in order of trust), a place, the mark of a derivative, and those counted for completeness.
DATE_TAGS = ("EXIF:DateTimeOriginal", "XMP:DateTimeOriginal", "EXIF:CreateDate", "XMP:CreateDate", "QuickTime:CreateDate")
GPS_TAGS = ("EXIF:GPSLatitude", "EXIF:GPSLongitude", "QuickTime:GPSCoordinates")
DERIVED_TAGS = ("XMP:DerivedFrom", "XMP-xmpMM:DerivedFrom")
CENSUS_TAGS = (
    "EXIF:DateTimeOriginal", "EXIF:Make", "EXIF:Model", "EXIF:ISO", "EXIF:FocalLength", "EXIF:ExposureTime", "EXIF:FNumber", "EXIF:Flash",
    "EXIF:Orientation", "EXIF:Software", "EXIF:LensModel", "EXIF:GPSLatitude", "EXIF:ColorSpace", "EXIF:WhiteBalance", "XMP:Rating", "XMP:Subject",
    "QuickTime:CreateDate", "QuickTime:Duration", "QuickTime:VideoFrameRate", "QuickTime:ImageWidth", "QuickTime:ImageHeight",
    "QuickTime:AudioChannels", "QuickTime:AudioSampleRate", "QuickTime:CompressorName", "QuickTime:GPSCoordinates",
)


def tool_records(output: DataFrame, text: str = "output") -> DataFrame:
    """(SourceFile, tags map<string,string>) of every object in a tool's JSON array; what stands around the array is cut off, broken output gives none."""
    array = F.regexp_extract(F.col(text), r"(?s)(\[.*\])", 1)
    records = F.from_json(array, "array<map<string,string>>")
    one = output.select(F.explode(F.coalesce(records, F.from_json(F.lit("[]"), "array<map<string,string>>"))).alias("tags"))
    return one.select(F.col("tags")["SourceFile"].alias("SourceFile"), "tags").where("SourceFile is not null")


def first_date(tags: Column) -> tuple[Column, Column]:
    """(date, tag) of the first date tag that can be read."""
    dates = [(exif_date(tags[t]), t) for t in DATE_TAGS]
    return F.coalesce(*[d for d, _ in dates]), F.coalesce(*[F.when(d.isNotNull(), t) for d, t in dates])


def any_tag(tags: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[tags[n] for n in names]).isNotNull()


def tag_count(tags: Column) -> Column:
    return sum((tags[n].isNotNull().cast("int") for n in CENSUS_TAGS), F.lit(0))


def extracts(paths: DataFrame, records: DataFrame) -> DataFrame:
    """One row a path: exif_date, exif_date_tag, exif_tag_count, gps_present, xmp_derived, xmp_rating, error.

    Records are bound by path; a path without one is kept, with a note. Of several records of a path the first by content counts.
    """
    tags = F.col("tags")
    when, which = first_date(tags)
    read = records.select(
        F.col("SourceFile").alias("path"), when.alias("exif_date"), which.alias("exif_date_tag"), tag_count(tags).alias("exif_tag_count"),
        any_tag(tags, GPS_TAGS).alias("gps_present"), any_tag(tags, DERIVED_TAGS).alias("xmp_derived"), rating(tags["XMP:Rating"]).alias("xmp_rating"),
    )
    fields = [c for c in read.columns if c != "path"]
    one = read.groupBy("path").agg(F.min(F.struct(*fields)).alias("r"))
    return paths.select("path").join(one, "path", "left").select(
        "path", *[F.col(f"r.{c}").alias(c) for c in fields], F.when(F.col("r").isNull(), "no record").alias("error")
    )


def merge_extracts(partials: DataFrame) -> DataFrame:
    """One row a path out of several tools' findings.

    partials: path, seq (the order of precedence), extracted_by array<string>, errors array<string>, file_type, pixel_width, pixel_height, exif_date,
    exif_date_tag, exif_tag_count, gps_present, xmp_derived. Dimensions of the raw developer win, then the first; dates of the metadata tool win, then the
    first; other fields take the first value that is not NULL, where False is a value; provenance and errors are united.

    Each field is a minimum of (precedence, value) pairs, aggregated before the shuffle. A NULL path raises no error but gives a row of its own.
    """
    def first(name: str, prefer: Column | None = None, of: list[str] | None = None, has: Column | None = None) -> Column:
        there = has if has is not None else F.col(name).isNotNull()
        rank = F.when(prefer, 0).otherwise(1) if prefer is not None else F.lit(0)
        return F.min(F.when(there, F.struct(rank.alias("r"), "seq", *(of or [name]))))

    by = lambda tool: F.array_contains(F.coalesce("extracted_by", F.array().cast("array<string>")), tool)
    simple = ["exif_tag_count", "gps_present", "xmp_derived"]
    merged = partials.groupBy("path").agg(
        first("file_type", has=F.coalesce("file_type", F.lit("")) != "").alias("t"),
        first("pixel_width", by("rawpy"), ["pixel_width", "pixel_height"]).alias("px"),
        first("exif_date", by("exiftool"), ["exif_date", "exif_date_tag"]).alias("d"),
        *[first(c).alias(f"s_{c}") for c in simple],
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("extracted_by")))).alias("extracted_by"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "errors"))), lambda x: F.coalesce(x["errors"], F.array().cast("array<string>")))).alias("errors"),
    )
    return merged.select(
        "path", F.col("t.file_type").alias("file_type"), F.col("px.pixel_width").alias("pixel_width"), F.col("px.pixel_height").alias("pixel_height"),
        F.col("d.exif_date").alias("exif_date"), F.col("d.exif_date_tag").alias("exif_date_tag"), *[F.col(f"s_{c}.{c}").alias(c) for c in simple], "extracted_by", "errors",
    )


def backfill(rows: DataFrame, found: DataFrame, overwrite: list[str], fill: list[str]) -> DataFrame:
    """Rows with values from found (by path): overwrite takes them where they are not NULL, fill only where the row's own is NULL."""
    new = found.select("path", *[F.col(c).alias(f"_{c}") for c in overwrite + fill])
    joined = rows.join(new, "path", "left")
    value = {c: F.coalesce(f"_{c}", c) for c in overwrite} | {c: F.coalesce(c, f"_{c}") for c in fill}
    return joined.select(*[value[c].alias(c) if c in value else F.col(c) for c in rows.columns])


def coverage(found: DataFrame) -> DataFrame:
    """One row (dates, places): how many paths have a date and a place."""
    return found.agg(F.count("exif_date").alias("dates"), F.count_if("gps_present").alias("places"))
