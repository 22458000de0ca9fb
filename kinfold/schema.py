"""Schema, domains and defaults of the manifest table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the table format.
#: Column, type, default for tables written before the column existed.
MANIFEST = [
    ("id", "bigint", None), ("source_path", "string", None), ("source_label", "string", None), ("action", "string", ""),
    ("source_hash", "string", None), ("phash", "string", None), ("hamming_distance", "int", None), ("group_id", "string", None),
    ("reason", "string", None), ("executed", "int", 0), ("user_decision", "string", ""), ("file_size_bytes", "bigint", None),
    ("shot_date", "string", None), ("creation_date", "string", None), ("mtime", "string", None), ("pixel_width", "int", None),
    ("pixel_height", "int", None), ("exif_tag_count", "int", None), ("gps_present", "int", 0), ("xmp_derived", "int", 0),
    ("score", "double", None), ("is_locked", "int", 0), ("outcome", "string", ""),
]

ACTIONS = ("EXACT", "REVIEW_DUPLICATE", "UNDATED", "KEEP", "")
FIELDS = ("File Name", "Folder", "Action", "Score", "Size (Bytes)", "Resolution", "Creation Date", "Shot Date", "Similarity", "Group Count", "Lock")


def align_manifest(df: DataFrame) -> DataFrame:
    """An older manifest in today's schema: absent columns with their defaults, dest_path dropped, the old action MOVE cleared.

    Applying it again changes nothing, and no row is added or lost. Columns of other names are kept, after these;
    values that do not cast become NULL.
    """
    have = set(df.columns)
    cols = [
        (F.col(n).try_cast(t) if n in have else F.lit(v).cast(t)).alias(n) if n != "action" or n not in have
        else F.when(F.col(n) == "MOVE", "").otherwise(F.col(n)).alias(n)
        for n, t, v in MANIFEST
    ]
    known = {n for n, _, _ in MANIFEST} | {"dest_path"}
    return df.select(*cols, *[c for c in df.columns if c not in known])
