"""File types by extension."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Type name -> (id, extensions). Lower ids win where an extension
# is in two lists.
TYPES = {
    "audio": (1, "mp3 mp2 m4a wav wma ogg flac aac ac3 aif aiff ape mpc mid midi ra wv opus"),
    "video": (2, "avi mpg mpeg mp4 mkv wmv mov flv ogm m4v rm rmvb vob asf divx xvid 3gp ts "
                 "m2ts webm mpe ifo"),
    "image": (3, "jpg jpeg png gif bmp tif tiff webp psd ico svg raw cr2 nef"),
    "pro": (4, "exe msi bat com dll deb rpm dmg apk jar app bin run"),
    "doc": (5, "doc docx pdf txt rtf odt xls xlsx ppt pptx epub mobi djvu chm tex ods odp"),
    "arc": (6, "zip rar 7z tar gz bz2 xz ace arj cab lzh z tgz zst"),
    "iso": (7, "iso nrg cue img bin mdf ccd cdi"),
}
COLLECTION_ID, COLLECTION_EXTENSION = 8, "emulecollection"

# Suffixes that cannot hold a very large file, and the size limit.
DOCUMENT_LIKE = ("pdf", "txt", "doc", "docx", "epub", "djvu", "chm", "mobi",
                 "jpg", "jpeg", "png", "gif")
DOCUMENT_LIKE_MAX_BYTES = 50 * 1024 * 1024


def last_part(lowered: Column) -> Column:
    """Text after the last dot; the whole name when there is none."""
    return F.substring_index(lowered, ".", -1)


def type_id(lowered: Column) -> Column:
    """Numeric type of a lowered name; 0 when the extension says nothing."""
    ext = last_part(lowered)
    out = F.when(~lowered.contains("."), F.lit(0))
    for number, extensions in TYPES.values():
        out = out.when(ext.isin(*extensions.split()), F.lit(number))
    return out.when(ext == COLLECTION_EXTENSION, F.lit(COLLECTION_ID)).otherwise(F.lit(0))


def has_type(lowered: Column, type_name: str) -> Column:
    """Does the name carry an extension of this type? Unknown types never exclude a dotted name."""
    dotted = lowered.contains(".")
    known = TYPES.get(type_name.lower())
    return dotted & last_part(lowered).isin(*known[1].split()) if known else dotted


def size_contradicts_extension(name: Column, size: Column) -> Column:
    """A document or picture suffix on a file too large to be one."""
    pattern = r"[.](" + "|".join(DOCUMENT_LIKE) + r")\z"
    return F.lower(name).rlike(pattern) & (size > DOCUMENT_LIKE_MAX_BYTES)
