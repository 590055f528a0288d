"""Files derived from the given tables: traces go in by arithmetic on the key, alike in Spark and in SQL.

The tables hold no private traces of their own, so each registered query plants some in every row's text.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import TEXT

#: Planted after character 1 + doc_id % length of a text, by (doc_id // 16) % 8.
TRACES = ["", "\u200b", "\u00a0", "\u200c", "\U0001f468\u200d\U0001f469", "\ufeff", "a\ufe0f", "\ue000"]
#: The same, for traces that cleaning lays bare.
STUBBORN = ["", "\u200b\u200d\u2764", "a\ufe0f\u200dx", "\u200b"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def plant(text: Column, key: Column, traces: list[str]) -> Column:
    at = (F.lit(1) + key % F.greatest(F.length(text), F.lit(1))).cast("int")
    trace = pick(F.floor(key / 16) % len(traces), traces)
    return F.concat(F.substring(text, F.lit(1), at), trace, F.substring(text, at + 1, F.length(text)))


def texts(spark: SparkSession, sf_dir: str, traces: list[str] = TRACES) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", pick(F.col("doc_id") % 16, list(TEXT)).alias("ext"), plant(F.col("text"), F.col("doc_id"), traces).alias("text"))


def pages(spark: SparkSession, sf_dir: str, hidden: bool = False) -> DataFrame:
    """``generator`` metadata in every third page, an attribute in every fifth; hidden: a character splits the word."""
    rows, key = table(spark, sf_dir, "pages"), F.col("page_id")
    name = "na\u200bme" if hidden else "name"
    meta = F.when(key % 3 == 0, f'<meta {name}="generator" content="x">').otherwise("")
    body = F.when(key % 5 == 0, F.replace(F.col("html"), F.lit("<body"), F.lit("<body data-ai-model='m'"))).otherwise(F.col("html"))
    return rows.select("page_id", F.concat(meta, body).alias("html"))


def svgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    meta = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<METADATA id="1">'), text, F.lit("</metadata >"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<svg>"), meta, F.lit("<text>"), text, F.lit("</text></svg>")).alias("text"))


def markdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    front = F.concat(F.lit("---\ntitle: t\n"), F.when(key % 2 == 0, "Generator: g\n").otherwise(""), F.when(key % 3 == 0, "  ai_model : m\n").otherwise(""), F.lit("---\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(key % 5 == 4, F.col("text")).otherwise(F.concat(front, F.col("text"))).alias("text"))


# --- binary files: parts with the whole text as payload --------------------------------------------------------------

#: Format: (extension, bytes around parts, parts). A part: (kind, category or None, label's place in the
#: domain, in each row whose key this divides, bytes besides the payload, payload times).
CONTAINERS: dict[str, tuple[str, list[tuple[str, str | None, int, int, int]]]] = {
    "png": ("png", [("IHDR", None, 1, 25, 0), ("tEXt", "png_text", 2, 12, 1), ("iCCP", "profile", 3, 12, 1), ("caBX", "png_origin", 5, 12, 1), ("IDAT", None, 1, 12, 1), ("IEND", None, 1, 12, 0)]),
    "webp": ("webp", [("VP8X", None, 1, 18, 0), ("VP8 ", None, 1, 8, 1), ("EXIF", "webp", 2, 8, 1), ("ICCP", "profile", 3, 8, 1), ("XMP ", "webp", 5, 8, 1)]),
    "wav": ("wav", [("fmt ", None, 1, 24, 0), ("LIST", "wav", 2, 12, 1), ("bext", "wav", 3, 8, 1), ("data", None, 1, 8, 1)]),
    "flac": ("flac", [("0", None, 1, 38, 0), ("4", "flac", 2, 4, 1), ("6", "flac", 3, 4, 1), ("2", None, 5, 4, 1), ("1", None, 1, 4, 1)]),
    "jpeg": ("jpg", [("E0", None, 1, 4, 1), ("exif", "jpeg_exif", 2, 10, 1), ("xmp", "jpeg_xmp", 3, 8, 1), ("EB", "jpeg_origin", 5, 4, 1), ("FE", "jpeg_note", 7, 4, 1), ("icc", "profile", 11, 16, 1)]),
    "gif": ("gif", [("FE", "gif", 2, 3, 1), ("FF", "gif", 3, 15, 0), ("image", None, 1, 14, 0)]),
    "mp3": ("mp3", [("ID3v2", "mp3", 2, 10, 1), ("audio", None, 1, 4, 1), ("APEv2", "mp3", 3, 32, 0), ("ID3v1", "mp3", 5, 128, 0)]),
    "iso": ("mp4", [("ftyp", None, 1, 16, 0), ("moov", "iso", 2, 8, 1), ("uuid", "iso", 3, 24, 1), ("mdat", None, 1, 8, 1)]),
}
#: Bytes before the first part and after the last one (times payload).
AROUND = {"png": (8, 0, 0), "webp": (12, 0, 0), "wav": (12, 0, 0), "flac": (4, 2, 1), "jpeg": (2, 4, 1), "gif": (13, 1, 0), "mp3": (0, 0, 0), "iso": (0, 0, 0)}
#: Chunks of these are padded to an even size; in the others the payload's size counts as it is.
PADDED = ("webp", "wav")
#: Payload bytes of a JPEG segment and of a GIF block; longer payloads take several.
JPEG_PAYLOAD, GIF_BLOCK = 65_000, 255


def _raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def _big(size: Column, digits: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(size.cast("long")), digits, "0"))


def _little(size: Column) -> Column:
    digits = F.lpad(F.hex(size.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]))


def _cut_up(p: Column, most: int, head: Callable[[Column], Column], least: int) -> Column:
    """The payload in pieces of up to ``most`` bytes, ``least`` pieces at least, a head before each."""
    count = F.greatest(F.ceil(F.length(p) / most).cast("int"), F.lit(least))
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    piece = lambda i: F.substring(p, i * most + 1, F.lit(most))
    return F.unhex(F.array_join(F.transform(at, lambda i: F.hex(F.concat(head(piece(i)), piece(i)))), ""))


def _part(name: str, kind: str, p: Column) -> Column:
    n = F.length(p)
    if name == "png":
        body = {"IHDR": _raw(bytes(13)), "IEND": _raw(b"")}.get(kind, p)
        return F.concat(_big(F.length(body)), _raw(kind.encode()), body, _raw(bytes(4)))
    if name in PADDED:
        body = {"VP8X": _raw(b"\x2c" + bytes(9)), "fmt ": _raw(bytes(16)), "LIST": F.concat(_raw(b"INFO"), p)}.get(kind, p)
        pad = F.when(F.length(body) % 2 == 1, _raw(b"\0")).otherwise(_raw(b""))
        return F.concat(_raw(kind.encode()), _little(F.length(body)), body, pad)
    if name == "flac":
        body = _raw(bytes(34)) if kind == "0" else p
        return F.concat(_raw(bytes([int(kind) | (0x80 if kind == "1" else 0)])), _big(F.length(body), 6), body)
    if name == "jpeg":
        marker, before = {"exif": (0xE1, b"Exif\0\0"), "xmp": (0xE1, b"http"), "icc": (0xE2, b"ICC_PROFILE\0")}.get(kind) or (int(kind, 16), b"")
        head = lambda x: F.concat(_raw(bytes([0xFF, marker])), _big(F.length(x) + 2 + len(before), 4), _raw(before))
        return _cut_up(p, JPEG_PAYLOAD, head, 1)
    if name == "gif":
        return {"FE": F.concat(_raw(b"\x21\xfe"), _cut_up(p, GIF_BLOCK, lambda x: _big(F.length(x), 2), 0), _raw(b"\0")), "FF": _raw(b"\x21\xff\x0bXMP DataXMP\0"), "image": _raw(b"\x2c" + bytes(9) + b"\x02\x01\0\0")}[kind]
    if name == "mp3":
        return {
            "ID3v2": F.concat(_raw(b"ID3\x03\0\0"), *[_big(F.shiftright(n, 7 * k).bitwiseAND(127), 2) for k in (3, 2, 1, 0)], p), "audio": F.concat(_raw(b"\xff\xfb\x90\0"), p),
            "APEv2": _raw(b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16)), "ID3v1": _raw(b"TAG" + bytes(125)),
        }[kind]
    if kind == "ftyp":
        return _raw(b"\0\0\0\x10ftypisom\0\0\0\0")
    if kind == "moov":
        return F.concat(_big(n + 8), _raw(b"udta"), p)
    if kind == "uuid":
        return F.concat(_big(n + 24), _raw(b"uuid" + bytes.fromhex("be7acfcb97a942e89c71999491e3afac")), p)
    return F.concat(_big(n + 8), _raw(kind.encode()), p)


def containers(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``path, length, content``: one file of the format for each document; private parts by doc_id."""
    ext, parts = CONTAINERS[name]
    key, p, body = F.col("doc_id"), F.col("payload"), F.col("body")
    # a column at a time: what is used more than once is put together once
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({f"part{k}": F.when(key % every == 0, _part(name, kind, p)).otherwise(_raw(b"")) for k, (kind, _, every, _, _) in enumerate(parts)})
    pieces = [F.col(f"part{k}") for k in range(len(parts))]
    if name == "iso":  # the second part stands inside the movie atom
        pieces[1] = F.concat(_big(F.length(pieces[1]) + 8), _raw(b"moov"), pieces[1])
    rows = rows.select("doc_id", "payload", F.concat(*pieces).alias("body")).withColumn("size", F.length("body"))
    if name in PADDED:
        content = F.concat(_raw(b"RIFF"), _little(F.col("size") + 4), _raw(b"WEBP" if name == "webp" else b"WAVE"), body)
    else:
        before = {"png": b"\x89PNG\r\n\x1a\n", "flac": b"fLaC", "jpeg": b"\xff\xd8", "gif": b"GIF89a" + bytes(7)}.get(name, b"")
        after = {"flac": F.concat(_raw(b"\xff\xf8"), p), "jpeg": F.concat(_raw(b"\xff\xda"), p, _raw(b"\xff\xd9")), "gif": _raw(b"\x3b")}.get(name, _raw(b""))
        content = F.concat(_raw(before), body, after)
    path = F.concat(F.lit("/in/"), key.cast("string"), F.lit(f".{ext}"))
    # exploded from an array of one: else each condition on the bytes would be moved below, with all of this in it
    return rows.select(path.alias("path"), F.explode(F.array(content)).alias("content")).select("path", F.length("content").cast("long").alias("length"), "content")


def _office(key: int, text: str) -> bytes:
    import io
    import zipfile

    out, body = io.BytesIO(), "".join(c for c in text if c.isalnum())
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/core.xml", f"<dc:creator>{body}</dc:creator><dc:title/>" if key % 2 == 0 else "<dc:title/>")
        if key % 3 == 0:
            z.writestr("word/comments.xml", body)
        z.writestr("word/document.xml", f"<w:p>{body}</w:p>" + (f"<w:ins>{body}</w:ins><w:del>old</w:del>" if key % 5 == 0 else ""))
    return out.getvalue()


def _pdf(key: int, text: str) -> bytes:
    body = "".join(c for c in text if c.isascii() and c.isalnum()).encode()
    parts = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/Count 0>>", b"<</Author (" + body + b")>>"]
    if key % 3 == 0:
        parts.append(b"<</Type/Metadata/Length %d>>\nstream\n" % len(body) + body + b"\nendstream")
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (k + 1) + p + b"\nendobj\n" for k, p in enumerate(parts))
    return out + b"trailer\n<</Root 1 0 R" + (b"/Info 3 0 R" if key % 2 == 0 else b"") + b">>\n"


def made(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """A document or PDF for each row of ``documents``: properties, comments and revisions by doc_id."""
    build = {"docx": _office, "pdf": _pdf}[ext]

    @F.arrow_udf("binary")
    def content(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([build(k.as_py(), t.as_py() or "") for k, t in zip(keys, texts, strict=True)], pa.binary())

    rows = table(spark, sf_dir, "documents").select("doc_id", content("doc_id", "text").alias("content"))
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(f".{ext}"))
    return rows.select(path.alias("path"), F.length("content").cast("long").alias("length"), "content")
