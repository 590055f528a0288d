"""File names, extensions and the detection of formats from bytes, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each family and the brands of ISO media.
IMAGE = ("jpg", "jpeg", "jpe", "png", "webp", "gif")
AUDIO = ("mp3", "wav", "flac")
ISO = ("mp4", "mov", "m4v", "m4a", "3g2", "3gp", "3gp2", "3gpp", "f4a", "f4b", "f4p", "f4v", "lrv", "m4b", "m4p", "mqv", "qt")
ISO_AUDIO = ("m4a", "f4a", "f4b", "m4b", "m4p")
OFFICE = ("docx", "xlsx", "pptx", "odt")
TEXT = ("txt", "md", "markdown", "html", "htm", "xhtml", "svg", "xml", "json", "csv", "tsv", "yaml", "yml", "log", "srt", "vtt")
SUPPORTED = (*IMAGE, *AUDIO, *ISO, *OFFICE, "pdf", *TEXT)
BRANDS = (
    "isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "avc1", "dash", "qt  ", "M4A ", "M4V ", "MSNV", "F4A ", "F4B ", "F4P ", "F4V ",
    "3gp1", "3gp2", "3gp3", "3gp4", "3gp5", "3gp6", "3gp7", "3gp8", "3gp9", "3g2a", "3g2b",
)


def file_name(path: Column) -> Column:
    """Last part of a path after a slash or backslash; the path itself if that is empty."""
    last = F.element_at(F.split(path, r"[\\/]"), -1)
    return F.when(last == "", path).otherwise(last)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot, none for names that only begin with a dot."""
    return F.translate(F.regexp_extract(name, r"(?s)^.+[.]([^.]*)$", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kind_extension(name: Column) -> Column:
    """For the queue's kinds: after the last dot, or the whole name without one."""
    return F.lower(F.element_at(F.split(name, "[.]"), -1))


def sort_extension(name: Column) -> Column:
    """For sorting: after the last dot if that isn't the first character, else empty."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+[.]([^.]*)$", 1))


def supported(ext: Column) -> Column:
    return ext.isin(*SUPPORTED)


def kind(name: Column) -> Column:
    ext = kind_extension(name)
    ladder = [("image", IMAGE), ("audio", (*AUDIO, *ISO_AUDIO)), ("video", [x for x in ISO if x not in ISO_AUDIO]), ("document", OFFICE), ("pdf", ["pdf"]), ("text", TEXT)]
    out = F.when(F.lit(False), "")
    for label, extensions in ladder:
        out = out.when(ext.isin(*extensions), label)
    return out.otherwise("unknown")


def number(content: Column, at: Column | int, size: int) -> Column:
    """Unsigned big-endian number of ``size`` bytes from the 0-based place ``at``."""
    place = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(content, place + 1, F.lit(size))), 16, 10).cast("decimal(20,0)")


def has_media_brand(content: Column) -> Column:
    """Whether the first atom is a file type that names a supported brand, as major or compatible one."""
    length = F.length(content)
    short = number(content, 0, 4)
    head = F.when(short == 1, 16).otherwise(8)
    size = F.when(short == 0, length).when(short == 1, number(content, 8, 8)).otherwise(short)
    whole = (length >= head) & (F.substring(content, 5, 4) == F.lit(b"ftyp")) & (size >= head + 8) & (size <= length)
    brand = lambda at: F.substring(content, at + 1, F.lit(4)).isin(*[F.lit(b.encode()) for b in BRANDS])
    rest = F.floor((size.cast("long") - head - 8) / 4).cast("int")
    others = F.exists(F.when(rest > 0, F.sequence(F.lit(0), rest - 1)).otherwise(F.array().cast("array<int>")), lambda i: brand(head + 8 + i * 4))
    return F.coalesce(F.when(whole, brand(head) | others), F.lit(False))


def detect(ext: Column, content: Column) -> Column:
    """Name of the first format whose rule fits; bytes outrank the extension."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda magic: head.startswith(magic.hex().upper())
    riff = lambda kind: starts(b"RIFF") & (F.substring(head, 17, 8) == kind.hex().upper())
    return (
        F.when(starts(b"\xff\xd8\xff"), "JPEG")
        .when(starts(b"\x89PNG\r\n\x1a\n"), "PNG")
        .when(riff(b"WEBP"), "WebP")
        .when(starts(b"GIF87a") | starts(b"GIF89a"), "GIF")
        .when(starts(b"ID3") | head.rlike("^FF[EF]"), "MP3")
        .when(riff(b"WAVE"), "WAV")
        .when(starts(b"fLaC"), "FLAC")
        .when(ext.isin(*ISO) & has_media_brand(content), "MP4 / QuickTime")
        .when(starts(b"%PDF-"), "PDF")
        .when(starts(b"PK") & ext.isin(*OFFICE), "Office")
        .when(ext.isin(*TEXT) & F.is_valid_utf8(content.cast("string")), "Text")
        .otherwise("Unsupported")
    )
