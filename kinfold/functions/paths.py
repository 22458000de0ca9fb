"""Scalar functions on paths and file names. NULL in, NULL out; '/' parts a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are read, by the kind of file each stands for.
TYPE_OF_EXTENSION = {
    "jpg": "jpeg", "jpeg": "jpeg", "heic": "heic", "heif": "heic", "png": "png", "gif": "gif", "webp": "webp",
    "tif": "raw", "tiff": "raw", "dng": "raw", "cr2": "raw", "cr3": "raw", "nef": "raw", "arw": "raw", "raf": "raw", "rw2": "raw",
    "mp4": "mp4", "m4v": "mp4", "avi": "mp4", "mov": "mov",
}
# Video extensions, file names and directory names that are left out.
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi")
SKIP_NAMES = ("thumbs.db", "desktop.ini", "failed_inserting_exif.txt", ".ds_store")
SKIP_DIRECTORIES = ("$recycle.bin", "system volume information", ".trashes", ".trash")
# Endings that mark an edited copy, in the order they are tried.
EDITED_ENDINGS = ("-已編輯", "(已編輯)", "-edited", "-Edit", "_edited", " edited")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent(path: Column) -> Column:
    """The path without its last part and the slash before it; '' if there is none."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def folder(path: Column) -> Column:
    """The parent with a slash after it."""
    return F.concat(parent(path), F.lit("/"))


def suffix(path: Column) -> Column:
    """The extension in lower case without its dot; '' for names without one, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    """The name without its extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def file_type(path: Column) -> Column:
    """The kind of file its extension stands for, 'skip' if none."""
    kind = F.create_map(*[F.lit(x) for kv in TYPE_OF_EXTENSION.items() for x in kv])
    return F.when(path.isNotNull(), F.coalesce(kind[suffix(path)], F.lit("skip")))


def is_media(path: Column) -> Column:
    return suffix(path).isin(*TYPE_OF_EXTENSION)


def is_video(path: Column) -> Column:
    return suffix(path).isin(*VIDEO_EXTENSIONS)


def is_skipped_name(path: Column) -> Column:
    return F.lower(basename(path)).isin(*SKIP_NAMES)


def in_skipped_directory(path: Column, root: str = "") -> Column:
    """Whether a directory between root and file is one of those left out, in any letter case."""
    below = F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path) if root else path
    return F.arrays_overlap(F.split(F.lower(parent(below)), "/"), F.array(*[F.lit(d) for d in SKIP_DIRECTORIES]))


def has_unsafe_name(path: Column) -> Column:
    """Whether the name ends with a dot or white space, which some systems cannot address."""
    return basename(path).rlike(r"[.\s]$")


def name_parts(path: Column) -> dict[str, Column]:
    """base_stem, number, is_edited, clean_stem: a number in brackets at the end is a copy's, the first edited ending that fits is cut."""
    return stem_parts(stem(path))


def stem_parts(whole: Column) -> dict[str, Column]:
    """`name_parts` of a name without its extension. Each use of a part repeats the search in `whole`, so that should be a column, not an expression."""
    number = F.regexp_extract(whole, r"^(?s:.*)\((\d+)\)$", 1)
    base = F.when(number != "", F.regexp_replace(whole, r"\(\d+\)$", "")).otherwise(whole)
    clean, edited = base, F.lit(False)
    for e in reversed(EDITED_ENDINGS):
        clean = F.when(base.endswith(e), F.substr(base, F.lit(1), F.length(base) - len(e))).otherwise(clean)
        edited = edited | base.endswith(e)
    return {"base_stem": base, "number": F.when(number != "", number.try_cast("int")), "is_edited": edited, "clean_stem": clean}


def device_key(path: Column) -> Column:
    r"""The drive letter and colon in upper case, or \\SERVER of a network path; '' for other paths."""
    drive = F.upper(F.regexp_extract(path, r"^([A-Za-z]:)", 1))
    server = F.upper(F.regexp_extract(F.translate(path, "/", "\\"), r"^\\\\([^\\]+)", 1))
    return F.when(drive != "", drive).when(server != "", F.concat(F.lit("\\\\"), server)).otherwise(F.when(path.isNotNull(), ""))


def magic_type(content: Column) -> Column:
    """The kind of file its first 12 bytes tell, NULL if none is known."""
    h = F.upper(F.hex(F.substring(content, 1, 12)))
    brand = F.lower(F.decode(F.substring(content, 9, 4), "ISO-8859-1"))
    # Brands of the container that hold still pictures, and those that hold films.
    stills = ("heic", "heix", "mif1", "msf1", "heim", "heis", "hevc")
    films = ("mp41", "mp42", "isom", "iso2", "avc1", "f4v ", "m4v ")
    boxed = (F.substr(h, F.lit(9), F.lit(8)) == "66747970") & (F.length(h) == 24)
    return (
        F.when(h.startswith("FFD8"), "jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "gif")
        .when(h.startswith("52494646") & h.endswith("57454250") & (F.length(h) == 24), "webp")
        .when(boxed & brand.isin(*stills), "heic")
        .when(boxed & brand.isin(*films), "mp4")
        .when(boxed & (brand == "qt  "), "mov")
    )
