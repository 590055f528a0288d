import io
import struct
import zipfile
import zlib

import pytest

from spoorless.operators import containers as c
from spoorless.operators import engine, office, pdf
from spoorless.schemas import Options, Refused


def seg(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def chunk(kind, body, order=">", tail=True):
    return struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0" if order == ">" else kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def riff(form, *chunks):
    body = form + b"".join(chunk(k, b, "<") for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def atom(kind, body=b""):
    return struct.pack(">I", len(body) + 8) + kind + body


TIFF = b"MM" + struct.pack(">HIHHHIHHI", 42, 8, 1, 0x112, 3, 1, 6, 0, 0)
PNG = b"\x89PNG\r\n\x1a\n"
FLAC = b"fLaC" + b"\0\0\0\x22" + bytes(34)
SAMPLES = {
    "JPEG": b"\xff\xd8" + seg(0xE1, b"Exif\0\0x") + seg(0xE1, b"http") + seg(0xEB, b"c2pa") + seg(0xED, b"iptc") + b"\xff\xd9",
    "PNG": PNG + chunk(b"IHDR", bytes(13)) + chunk(b"tEXt", b"Author") + chunk(b"caBX", b"x") + chunk(b"IEND", b""),
    "WebP": riff(b"WEBP", (b"VP8X", b"\x2c" + bytes(9)), (b"EXIF", b"abc"), (b"ICCP", b"p")),
    "GIF": b"GIF89a" + bytes(7) + b"\x21\xfe\x02hi\0" + b"\x2c" + bytes(9) + b"\x02\x01\0\0" + b"\x3b",
    "MP3": b"ID3\x03\0\0\0\0\0\x02hi" + b"\xff\xfb\x90\0" + b"APETAGEX" + struct.pack("<II", 2000, 32) + bytes(16) + b"TAG" + bytes(125),
    "WAV": riff(b"WAVE", (b"fmt ", bytes(16)), (b"LIST", b"INFOx"), (b"data", b"ab")),
    "FLAC": FLAC + b"\x04\0\0\x01x" + b"\x86\0\0\x01y" + b"\xff\xf8",
    "MP4 / QuickTime": atom(b"ftyp", b"isom\0\0\0\0") + atom(b"moov", atom(b"mvhd") + atom(b"udta", b"u") + atom(b"trak", atom(b"meta"))) + atom(b"uuid", c.ADOBE_XMP + b"x") + atom(b"mdat", b"m"),
}
COUNTS = {"JPEG": 4, "PNG": 2, "WebP": 2, "GIF": 1, "MP3": 3, "WAV": 1, "FLAC": 2, "MP4 / QuickTime": 3}
ALL = Options(preserve_orientation=False, preserve_color_profile=False)


@pytest.mark.parametrize("name", SAMPLES)
def test_scan_clean_verify_rescan(name):
    data = SAMPLES[name]
    assert sum(f["count"] for f in c.inspect(name, data)) == COUNTS[name]
    cleaned, removed = c.clean(name, data, ALL)
    assert sum(f["count"] for f in removed) == COUNTS[name]
    c.verify(name, cleaned, ALL)
    assert c.inspect(name, cleaned) == [] and c.clean(name, cleaned, ALL)[0] == cleaned
    with pytest.raises(Refused):
        c.verify(name, data, ALL)


@pytest.mark.parametrize("name", SAMPLES)
def test_cut_files_are_refused_or_sound(name):
    for stop in range(len(SAMPLES[name])):
        try:
            cleaned, _ = c.clean(name, SAMPLES[name][:stop], ALL)
            c.verify(name, cleaned, ALL)
        except Refused as refused:
            assert refused.code == "InvalidFormat"


def test_exact_bytes():
    assert c.clean("JPEG", SAMPLES["JPEG"], ALL)[0] == b"\xff\xd8\xff\xd9"
    assert c.clean("MP3", SAMPLES["MP3"], ALL)[0] == b"\xff\xfb\x90\0"
    assert c.clean("FLAC", SAMPLES["FLAC"], ALL)[0] == b"fLaC\x80" + FLAC[5:] + b"\xff\xf8"
    assert len(c.clean("MP4 / QuickTime", SAMPLES["MP4 / QuickTime"], ALL)[0]) == len(SAMPLES["MP4 / QuickTime"])
    webp = c.clean("WebP", SAMPLES["WebP"], Options())[0]
    assert webp[20] == 0x20 and b"ICCP" in webp and struct.unpack("<I", webp[4:8])[0] == len(webp) - 8
    assert c.clean("WebP", SAMPLES["WebP"], ALL)[0][20] == 0


def test_orientation_and_profile():
    data = b"\xff\xd8" + seg(0xFE, b"note") + seg(0xE1, b"Exif\0\0" + TIFF) + seg(0xE2, b"ICC_PROFILE\0p") + b"\xff\xd9"
    kept, removed = c.clean("JPEG", data, Options())
    assert kept == b"\xff\xd8" + c.orientation_segment(6) + seg(0xE2, b"ICC_PROFILE\0p") + b"\xff\xd9"
    assert len(c.orientation_segment(6)) == 36 and sum(f["count"] for f in removed) == 2
    c.verify("JPEG", kept, Options())
    assert sum(f["count"] for f in c.inspect("JPEG", kept)) == 2
    assert c.clean("JPEG", data, ALL)[0] == b"\xff\xd8\xff\xd9"
    with pytest.raises(Refused):
        c.verify("JPEG", b"\xff\xd8" + c.orientation_segment(6) * 2 + b"\xff\xd9", Options())


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office():
    data = zipped({
        "docProps/core.xml": "<dc:creator>me</dc:creator><dc:title/>", "word/comments.xml": "<x/>", "word/document.xml": "<w:del a='1'>old</w:del><w:ins>new</w:ins>",
        "word/_rels/document.xml.rels": '<Relationship Target="comments.xml"/><Relationship Target="x"/>', "raw.bin": b"\xff\xfe",
    })
    assert sorted((f["label"], f["count"]) for f in office.inspect(data)) == sorted([("文档属性与作者信息", 1), ("批注与自定义 XML", 1), ("修订记录", 2)])
    cleaned, _ = office.clean(data)
    with zipfile.ZipFile(io.BytesIO(cleaned)) as z:
        assert "word/comments.xml" not in z.namelist() and z.read("raw.bin") == b"\xff\xfe"
        assert z.read("word/document.xml") == b"new" and z.read("docProps/core.xml") == b"" and z.read("word/_rels/document.xml.rels") == b'<Relationship Target="x"/>'
    assert office.inspect(cleaned) == []
    assert office.revision_count("<w:moveFrom>a</w:moveFrom><w:moveTo>b</w:moveTo><w:pPrChange>c</w:pPrChange><w:commentReference w:id='1'/>") == 4
    nested = zipped({"word/document.xml": "<w:ins><w:ins>a</w:ins></w:ins>"})
    with pytest.raises(Refused):
        engine.verify_bytes("Office", office.clean(nested)[0], ALL)
    with pytest.raises(Refused, match="ZIP|zip"):
        office.inspect(b"PK nothing")


def document(info=b"/Author (Old Name)", more=b""):
    body = b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R/Metadata 4 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[]/Count 0/Title (t)>> endobj\n3 0 obj <<" + info + b">> endobj\n"
    xmp = b"<x>Old Name</x>" * 20
    body += b"4 0 obj <</Type/Metadata/Length %d>> stream\n" % len(xmp) + xmp + b"\nendstream endobj\n" + more
    return body + b"xref\n0 0\ntrailer <</Root 1 0 R/Info 3 0 R/Size 5>>\nstartxref\n%d\n%%%%EOF\n" % len(body)


def test_pdf():
    data = document()
    assert pdf.inspect(data)[0]["count"] == 3  # the reference to the information, the stream, the catalog's key
    cleaned, _ = pdf.clean(data)
    assert pdf.inspect(cleaned) == [] and b"Old Name" not in cleaned and b"Title" not in cleaned and b"Catalog" in cleaned
    assert pdf.clean(cleaned)[0] == cleaned
    update = data + b"5 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n"
    update += b"xref\n0 0\ntrailer <</Root 5 0 R/Size 6>>\nstartxref\n%d\n%%%%EOF\n" % len(update)
    again, _ = pdf.clean(update)
    assert b"Old Name" not in again and pdf.inspect(again) == []
    packed = zlib.compress(b"7 0 8 31 <</Type/Pages/Kids[]/Count 0>> <</A 1>>")
    streamed = b"%%PDF-1.5\n1 0 obj <</Type/Catalog/Pages 7 0 R>> endobj\n6 0 obj <</Type/ObjStm/N 2/First 9/Filter/FlateDecode/Length %d>> stream\n" % len(packed) + packed + b"\nendstream endobj\ntrailer <</Root 1 0 R>>"
    assert b"/Type /Pages" in pdf.clean(streamed)[0]
    for broken in (b"%PDF-", document().replace(b"/Root", b"/Boot"), document().replace(b"/Size 5", b"/Encrypt 9 0 R")):
        with pytest.raises(Refused) as refused:
            pdf.inspect(broken)
        assert refused.value.code == "Pdf"
