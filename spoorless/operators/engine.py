"""Scanning, cleaning and verifying a DataFrame of files.

``files`` has ``path, length, content`` and, where known, ``xattrs`` (array of name and value) and ``pos``, the place
of a request, which is handed on; a path that is asked for twice has a row for each. Texts stay in
Catalyst expressions; only the bytes of binary containers cross into Python, once, in small batches.
Whatever is wrong with a file becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, markup
from ..schemas import ERRORS, FINDINGS, MAX_INPUT_BYTES, PRIVATE_XATTRS, SEGMENT, Options, Refused
from . import containers, office, pdf, queue

UNSUPPORTED_DETAIL = "未知格式"


def private_xattrs(xattrs: Column) -> Column:
    return F.filter(xattrs, lambda x: x["name"].isin(*PRIVATE_XATTRS))


def _xattr_finding(files: DataFrame) -> Column:
    if "xattrs" not in files.columns:
        return F.array().cast(FINDINGS)
    return F.array_compact(F.array(markup.finding("xattr", F.size(private_xattrs(F.coalesce("xattrs", F.array().cast(files.schema["xattrs"].dataType))))))).cast(FINDINGS)


def _carried(files: DataFrame) -> list[str]:
    return [c for c in ("pos",) if c in files.columns]


def kept_xattrs(files: DataFrame, remove_private: bool) -> list[Column]:
    """The extended attributes that a cleaned file gets, where they are known: all, or all but the private ones."""
    if "xattrs" not in files.columns:
        return []
    kept = F.filter("xattrs", lambda x: ~x["name"].isin(*PRIVATE_XATTRS)) if remove_private else F.col("xattrs")
    return [kept.alias("kept_xattrs")]


def prepared(files: DataFrame, *more: Column) -> DataFrame:
    """``path, name, ext, size, format, content, extra``; the content of too large files isn't read."""
    name = formats.file_name(F.col("path"))
    fits = F.col("length") <= MAX_INPUT_BYTES
    rows = files.select("path", name.alias("name"), formats.extension(name).alias("ext"), F.col("length").alias("size"), F.when(fits, F.col("content")).alias("content"), _xattr_finding(files).alias("extra"), *more, *_carried(files))
    found = F.when(F.col("size") > MAX_INPUT_BYTES, "Unknown").otherwise(formats.detect(F.col("ext"), F.col("content")))
    return once(rows.withColumn("_found", found), "format", F.col("_found")).drop("_found")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once, whatever is asked of it above.

    Exploding an array of one keeps the optimiser from moving conditions on the column, and with them all of
    its expression, below.
    """
    return rows.withColumn(name, F.explode(F.array(value)))


def _refusal() -> tuple[Column, Column]:
    """Code and text for what no family takes; null for the rest."""
    large, unknown = F.col("format") == "Unknown", F.col("format") == "Unsupported"
    code = F.when(large, "TooLarge").when(unknown, "Unsupported")
    return code, F.when(large, F.concat(F.lit(ERRORS["TooLarge"]), "path")).when(unknown, F.lit(ERRORS["Unsupported"] + UNSUPPORTED_DETAIL))


def inspect_bytes(name: str, data: bytes) -> list[dict]:
    return {"Office": office.inspect, "PDF": pdf.inspect}.get(name, lambda d: containers.inspect(name, d))(data)


def clean_bytes(name: str, data: bytes, options: Options) -> tuple[bytes, list[dict]]:
    if name in ("Office", "PDF"):
        return {"Office": office.clean, "PDF": pdf.clean}[name](data)
    return containers.clean(name, data, options)


def verify_bytes(name: str, data: bytes, options: Options) -> None:
    if name in ("Office", "PDF"):
        if left := sum(f["count"] for f in inspect_bytes(name, data)):
            raise Refused("Verification", f"{name}: {left} traces left")
    else:
        containers.verify(name, data, options)


_FINDING_TYPE = pa.list_(pa.struct([("category", pa.string()), ("label", pa.string()), ("count", pa.int64()), ("severity", pa.string())]))


_RESULT = f"struct<findings: {FINDINGS}, cleaned: binary, code: string, error: string>"
_RESULT_TYPE = pa.struct([("findings", _FINDING_TYPE), ("cleaned", pa.binary()), ("code", pa.string()), ("error", pa.string())])


def _kernel(options: Options | None) -> Column:
    """Inspect, or clean and verify, each container once. Rows of other families carry no bytes into Python."""

    def one(name: str, data: bytes) -> dict:
        try:
            if options is None:
                return {"findings": inspect_bytes(name, data)}
            cleaned, removed = clean_bytes(name, data, options)
            verify_bytes(name, cleaned, options)
            return {"findings": removed, "cleaned": cleaned}
        except Refused as refused:
            return {"findings": [], "code": refused.code, "error": refused.text}
        except (RecursionError, ValueError, IndexError, KeyError, OverflowError, AttributeError, TypeError) as broken:  # a file that no check foresaw
            return {"findings": [], "code": "InvalidFormat", "error": ERRORS["InvalidFormat"] + type(broken).__name__}

    @F.arrow_udf(_RESULT)
    def kernel(names: pa.Array, contents: pa.Array) -> pa.Array:
        return pa.array([one(n.as_py(), c.as_py()) if c.is_valid else None for n, c in zip(names, contents, strict=True)], _RESULT_TYPE)

    binary = F.col("format").isin(*containers.WALKERS, "Office", "PDF")
    return kernel(F.col("format"), F.when(binary, F.col("content")))


def scan(files: DataFrame) -> DataFrame:
    """A report a file: ``path, name, format, size, supported, findings, error_code, error``. Files are read once."""
    rows = prepared(files)
    text = F.when(F.col("format") == "Text", markup.text_findings(F.col("content").cast("string"), F.col("ext")))
    carried = _carried(files)
    rows = rows.select("path", "name", "format", "size", "extra", text.alias("text"), _kernel(None).alias("k"), *carried)
    refused, shown = _refusal()
    error = F.coalesce(shown, F.col("k.error"))
    found = F.when(error.isNull(), F.concat(F.coalesce("text", "k.findings"), "extra")).otherwise(F.array().cast(FINDINGS))
    size = F.when(F.col("format") == "Unknown", 0).otherwise(F.col("size"))
    return rows.select("path", "name", "format", size.alias("size"), error.isNull().alias("supported"), found.alias("findings"), F.coalesce(refused, F.col("k.code")).alias("error_code"), error.alias("error"), *carried)


def clean(files: DataFrame, options: Options = Options()) -> DataFrame:
    """A candidate a file, verified: ``path, name, format, source_size, cleaned, output_size, removed, success, error_code, error``.

    ``cleaned`` is null wherever an error stands, so nothing unverified can reach a sink. Where ``files`` tells
    extended attributes, ``kept_xattrs`` are those that the cleaned file gets.
    """
    kept = kept_xattrs(files, options.remove_extended_attributes)
    rows = prepared(files, *kept)
    more = [*_carried(files), *(["kept_xattrs"] if kept else [])]
    is_text, body = F.col("format") == "Text", F.col("content").cast("string")
    texts = F.when(is_text, F.struct(markup.clean_markup(body, F.col("ext")).alias("candidate"), markup.text_findings(body, F.col("ext")).alias("findings")))
    rows = once(rows.select("path", "name", "ext", "format", "size", "extra", _kernel(options).alias("k"), texts.alias("_t"), *more), "t", F.col("_t"))
    rows = rows.withColumn("bytes", F.coalesce(F.encode("t.candidate", "UTF-8"), "k.cleaned")).withColumn("removed", F.coalesce("t.findings", "k.findings"))
    left = F.when(is_text, queue.residual(markup.text_findings(F.col("t.candidate"), F.col("ext"))))
    checks = F.struct(formats.detect(F.col("ext"), F.col("bytes")).alias("now"), left.alias("left"))
    rows = once(rows.select("path", "name", "format", "size", "extra", "k", "bytes", "removed", checks.alias("_c"), *more), "c", F.col("_c"))
    refused, shown = _refusal()
    changed = F.col("bytes").isNotNull() & (F.col("c.now") != F.col("format"))
    text = (
        F.when(changed, F.concat(F.lit(ERRORS["Verification"]), "format", F.lit(" -> "), "c.now"))
        .when(F.col("c.left") > 0, F.concat(F.lit(ERRORS["Verification"] + "Text: "), F.col("c.left").cast("string"), F.lit(" traces left")))
    )
    rows = rows.withColumn("error", F.coalesce(shown, F.col("k.error"), text)).withColumn("error_code", F.coalesce(refused, F.col("k.code"), F.when(text.isNotNull(), "Verification")))
    fine = F.col("error").isNull()
    removed = F.concat("removed", "extra") if options.remove_extended_attributes else F.col("removed")
    return rows.select(
        "path", "name", "format", F.when(fine, F.col("size")).alias("source_size"), F.when(fine, F.col("bytes")).alias("cleaned"), F.when(fine, F.length("bytes").cast("long")).alias("output_size"),
        F.when(fine, removed).otherwise(F.array().cast(FINDINGS)).alias("removed"), fine.alias("success"), "error_code", "error", *more,
    )


def segments(files: DataFrame) -> DataFrame:
    """The segments of every sound container: ``path, idx, kind, start, stop, header_len, private, category``."""
    from ..schemas import DOMAIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, data in zip(*(batch.column(c) for c in ("path", "format", "content")), strict=True):
                try:
                    found = list(containers.WALKERS[name.as_py()](data.as_py()))
                except Refused:
                    continue
                columns = [[path.as_py()] * len(found), range(len(found)), [s.kind for s in found], [s.start for s in found], [s.stop for s in found], [s.header for s in found], [s.trace is not None for s in found], [DOMAIN[s.trace][0] if s.trace else None for s in found]]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["path", "idx", "kind", "start", "stop", "header_len", "private", "category"])

    rows = prepared(files).filter(F.col("format").isin(*containers.WALKERS))
    return rows.select("path", "format", "content").mapInArrow(run, SEGMENT)
