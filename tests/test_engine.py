import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spoorless.functions import formats
from spoorless.operators import engine, queue
from spoorless.schemas import PRIVATE_XATTRS, Options
from spoorless.sinks import files as sink
from spoorless.sources import intake

from .test_containers import SAMPLES

EXT = {"JPEG": "jpg", "PNG": "png", "WebP": "webp", "GIF": "gif", "MP3": "mp3", "WAV": "wav", "FLAC": "flac", "MP4 / QuickTime": "mp4"}


def make(folder):
    for name, data in SAMPLES.items():
        (folder / f"a.{EXT[name]}").write_bytes(data)
    (folder / "note.txt").write_text("a\u200bb")
    (folder / "bad.png").write_bytes(SAMPLES["PNG"][:20])
    (folder / "stubborn.txt").write_text("\u200b\u200d\u2764")
    (folder / "x.bin").write_bytes(b"zz")
    return sorted(str(p) for p in folder.iterdir())


def test_scan_clean_write_rescan(spark, tmp_path):
    paths = make(tmp_path)
    found = intake.read(spark, [*paths, str(tmp_path / "missing.txt"), paths[0]])
    assert found.count() == len(paths) + 2 and found.filter("error_code = 'Io'").count() == 1
    files = found.filter("error IS NULL").dropDuplicates(["path"])
    reports = {Path(r["path"]).name: r for r in engine.scan(files).collect()}
    assert reports["note.txt"]["findings"][0]["count"] == 1 and reports["x.bin"]["error_code"] == "Unsupported" and not reports["bad.png"]["supported"]
    assert all(reports[f"a.{e}"]["findings"] and reports[f"a.{e}"]["format"] == n for n, e in EXT.items())
    candidates = engine.clean(files, Options(preserve_orientation=False, preserve_color_profile=False)).cache()
    assert {Path(r["path"]).name: r["error_code"] for r in candidates.filter("NOT success").collect()} == {"bad.png": "InvalidFormat", "stubborn.txt": "Verification", "x.bin": "Unsupported"}
    assert candidates.filter("NOT success AND cleaned IS NOT NULL").count() == 0
    results = {Path(r["path"]).name: r for r in sink.write(candidates).collect()}
    assert (tmp_path / "note.cleaned.txt").read_text() == "ab" and (tmp_path / "note.txt").read_text() == "a\u200bb"
    assert (results["note.txt"]["source_size"], results["note.txt"]["output_size"]) == (5, 2)
    again = intake.read(spark, [r["output_path"] for r in results.values() if r["success"]])
    assert engine.scan(again).filter("size(findings) > 0 OR NOT supported").count() == 0


def test_replace_keeps_a_backup(spark, tmp_path):
    path = tmp_path / "n.txt"
    path.write_text("a\u200bb")
    os.chmod(path, 0o640)
    for copies in (1, 2):
        path.write_text("a\u200bb")
        options = Options(mode="replace")
        (row,) = sink.write(engine.clean(intake.read(spark, [str(path)]), options), options).collect()
        assert row["success"] and path.read_text() == "ab" and path.stat().st_mode & 0o777 == 0o640
    assert (tmp_path / "n.txt.bak").read_text() == (tmp_path / "n.txt-2.bak").read_text() == "a\u200bb"


def test_names(tmp_path):
    assert sink.cleaned_path(Path("/d/report.pdf")).name == "report.cleaned.pdf" and sink.cleaned_path(Path("/d/.rc")).name == ".rc.cleaned"
    (tmp_path / "output").touch()
    (tmp_path / "r.cleaned.pdf").touch()
    assert sink.unique_path(tmp_path / "output").name == "output-2" and sink.unique_path(tmp_path / "r.cleaned.pdf").name == "r.cleaned-2.pdf"


def test_intake(tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.pdf", "d/b.JPG", "d/c.mkv", "d/.hidden", "unknown.bin"):
        (tmp_path / name).touch()
    (tmp_path / "link").symlink_to(tmp_path / "d")
    got = intake.expand([str(tmp_path / "d"), str(tmp_path / "unknown.bin"), str(tmp_path / "a.pdf"), str(tmp_path / "a.pdf"), str(tmp_path / "none")])
    assert [Path(f).name for f in got.files] == ["a.pdf", "b.JPG", "unknown.bin"] and got.skipped_count == 3
    assert intake.expand([str(tmp_path / "link")]).issues == [(str(tmp_path / "link"), intake.REASONS["link"])]
    assert intake.launch_paths([str(tmp_path / "a.pdf"), "no"]) == [str(tmp_path / "a.pdf")]


def test_supported_extensions_and_xattrs(spark):
    assert len(formats.SUPPORTED) == len(set(formats.SUPPORTED)) == 47
    files = spark.createDataFrame([("/x.txt", 1, b"a", [("com.apple.quarantine", b""), ("user.x", b"")])], "path string, length bigint, content binary, xattrs array<struct<name: string, value: binary>>")
    (r,) = engine.scan(files).collect()
    assert [(f["category"], f["count"]) for f in r["findings"]] == [("macos_xattr", 1)]
    assert engine.clean(files).first()["removed"] == [] and len(engine.clean(files, Options(remove_extended_attributes=True)).first()["removed"]) == 1


def test_queue_sort(spark):
    rows = [("1", 0, "zeta", "a", 2048, None), ("2", 1, "alpha", "a", 2048, 1024), ("3", 2, "beta", "b", 2048, None)]
    q = spark.createDataFrame(rows, "id string, idx int, name string, type string, source_size int, output_size int")
    names = lambda *a: [r["name"] for r in queue.sort(q, *a).collect()]
    assert names("name") == ["alpha", "beta", "zeta"] and names("type") == ["zeta", "alpha", "beta"] and names("type", True) == ["beta", "zeta", "alpha"]
    assert names("output_size") == names("output_size", True) == ["alpha", "zeta", "beta"]
    assert queue.all_done(q.limit(0).withColumn("status", F.lit("clean"))).first()[0] is False


def test_extended_attributes_follow_the_option(tmp_path):
    source = tmp_path / "note.txt"
    source.write_bytes(b"a")
    try:
        os.setxattr(source, "user.kept", b"1")
    except OSError:
        pytest.skip("this file system has no extended attributes")
    private = f"user.{PRIVATE_XATTRS[0]}"
    os.setxattr(source, private, b"2")
    for remove in (False, True):
        target = tmp_path / f"out{remove}.txt"
        sink.write_atomically(target, b"b", os.lstat(source), True, source, not remove)
        assert set(os.listxattr(target)) == ({"user.kept"} if remove else {"user.kept", private})
