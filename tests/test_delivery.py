import os
import random
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spoorless.operators import engine, naming, queue
from spoorless.schemas import PRIVATE_XATTRS, Options
from spoorless.sinks import committed


def test_ranked_equals_row_number_on_a_million_rows(spark):
    rows = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003).alias("v"), F.col("id").alias("place_of"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = queue.ranked(rows, F.col("v"))
        assert found.columns == ["v", "place_of", "place"]
        # v takes each value once: its place is how many values are not above it
        want = rows.select("v").orderBy("v").toPandas()["v"].tolist()
        got = found.orderBy("place").toPandas()
        assert got["v"].tolist() == want and got["place"].tolist() == list(range(1, 1_000_001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert queue.ranked(rows.limit(0), F.col("v")).count() == 0


def test_a_limit_by_position_is_not_made_up_for(spark):
    rows = spark.createDataFrame([(g, p, p % 2 == 0) for g in "ab" for p in range(1, 9)], "g string, pos int, there boolean")
    found = queue.first_by_position(rows, 3, "g").filter("there")
    assert sorted(map(tuple, found.collect())) == [("a", 2, True), ("b", 2, True)]
    assert sorted(map(tuple, queue.first_by_position(rows.filter("g = 'a'"), 3).filter("there").collect())) == [("a", 2, True)]


def one_by_one(wanted, taken, most):
    """The rule for one row after the other, other rows' wanted names being taken for numbers."""
    taken, names = set(taken), {(f, n) for _, f, n in wanted}
    out, used = [], set(taken)
    for pos, folder, name in sorted(wanted):
        stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        tries = [name, *[f"{stem}-{k}{dot}{ext}" for k in range(2, most + 1)]]
        free = [n for k, n in enumerate(tries) if (folder, n) not in used and (k == 0 or (folder, n) not in names)]
        out.append((pos, folder, name, free[0] if free else name))
        used.add((folder, out[-1][3]))
    return out


@pytest.mark.parametrize("most", [9, 9_999])
def test_free_names_against_one_after_the_other(spark, most):
    rng = random.Random(most)
    names = ["a.txt", "a-2.txt", "b.tar.gz", ".rc", "none", "a-3.txt", "x-2-2.txt", "x-2.txt", "x.txt"]
    wanted = [(k, rng.choice(["/d", "/e"]), rng.choice(names)) for k in range(90)]
    taken = [(f, n) for f in ("/d", "/e") for n in ("a.txt", "a-4.txt", "a-5.txt", "b.tar-2.gz", ".rc", ".rc-3", "none-10", "a-02.txt", "x-2-3.txt") if rng.random() < 0.7]
    df = spark.createDataFrame(wanted, "pos long, folder string, name string").repartition(5)
    found = naming.assigned(df, spark.createDataFrame(taken, "folder string, name string"), most)
    assert sorted(map(tuple, found.collect())) == one_by_one(wanted, taken, most)


def test_free_names_of_a_hot_name_run_out(spark):
    wanted = spark.range(12_000).select(F.col("id").alias("pos"), F.lit("/d").alias("folder"), F.lit("a.txt").alias("name"))
    taken = spark.createDataFrame([("/d", "a-5.txt")], "folder string, name string")
    found = naming.assigned(wanted, taken).orderBy("pos").toPandas()["given"].tolist()
    assert found[:5] == ["a.txt", "a-2.txt", "a-3.txt", "a-4.txt", "a-6.txt"] and found[9_997] == "a-9999.txt" and set(found[9_998:]) == {"a.txt"}
    assert naming.assigned(wanted.limit(0), taken).count() == 0


def test_names_of_rows(spark):
    rows = spark.createDataFrame([("/a/b.PDF",), (r"c:\x\y.txt",), ("/a/",), ("",), (None,), ("/",), ("..",), ("plain",)], "path string")
    got = rows.select("path", naming.path_row(F.col("path")).alias("r"), naming.report_name(F.col("path")).alias("n")).collect()
    assert [(r["r"]["name"], r["r"]["kind"]) for r in got][:4] == [("b.PDF", "pdf"), ("y.txt", "text"), ("/a/", "unknown"), ("", "unknown")]
    assert [r["n"] for r in got] == ["b.PDF", r"c:\x\y.txt", "a", naming.UNKNOWN_NAME, naming.UNKNOWN_NAME, naming.UNKNOWN_NAME, naming.UNKNOWN_NAME, "plain"]


def candidates(spark, folder, count=20):
    rows = [(k, str(folder / f"{k}.txt"), str(folder / f"{k}.cleaned.txt"), bytearray(f"text {k}".encode())) for k in range(count)]
    return spark.createDataFrame(rows, "pos long, path string, output_path string, cleaned binary").repartition(4)


def test_staged_files_show_up_on_commit_and_are_put_in_place_once(spark, tmp_path):
    sink, out = str(tmp_path / "sink"), tmp_path / "out"
    assert committed.listing(spark, sink).count() == 0
    committed.stage(candidates(spark, out), sink)
    listed = committed.listing(spark, sink)
    assert listed.count() == 20 and not out.exists()
    for _ in range(2):  # again changes nothing
        results = committed.publish(listed).collect()
        assert all(r["success"] for r in results) and len(list(out.iterdir())) == 20
    assert (out / "7.cleaned.txt").read_text() == "text 7"


def test_replacing_keeps_a_backup_and_refuses_links(spark, tmp_path):
    source, link = tmp_path / "s.txt", tmp_path / "l.txt"
    source.write_text("old")
    os.chmod(source, 0o640)
    link.symlink_to(source)
    rows = [(0, str(source), str(source), str(source) + ".bak", bytearray(b"new")), (1, str(link), str(link), None, bytearray(b"bad"))]
    committed.stage(spark.createDataFrame(rows, "pos long, path string, output_path string, backup_path string, cleaned binary"), str(tmp_path / "sink"))
    for _ in range(2):
        results = sorted(committed.publish(committed.listing(spark, str(tmp_path / "sink"))).collect())
        assert [(r["success"], r["error_code"]) for r in results] == [(True, None), (False, "Symlink")]
        assert source.read_text() == "new" and Path(f"{source}.bak").read_text() == "old" and source.stat().st_mode & 0o777 == 0o640


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    sink = tmp_path / "sink"
    bad = candidates(spark, tmp_path / "out").withColumn("cleaned", F.when(F.col("pos") == 13, F.raise_error(F.lit("no"))).otherwise(F.col("cleaned")).cast("binary"))
    with pytest.raises(Exception, match="no"):
        committed.stage(bad, str(sink))
    assert committed.listing(spark, str(sink)).count() == 0 and not list((sink / "staging").glob("*"))


def test_a_task_that_fails_after_writing_leaves_one_copy(tmp_path):
    script = f"""
        import os, sys
        sys.path.insert(0, {str(Path(__file__).parents[1])!r})
        from pyspark.sql import SparkSession
        from spoorless.sinks import committed
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        rows = spark.range(0, 40, 1, 4).selectExpr("id AS pos", "concat('/in/', id) AS path", "concat('{tmp_path}/out/', id) AS output_path", "cast(concat('text ', id) AS binary) AS cleaned")

        def breaks(batches):
            for batch in batches:
                yield batch
                if 12 in batch.column(0).to_pylist() and not os.path.exists("{tmp_path}/broken"):
                    open("{tmp_path}/broken", "w").close()
                    raise RuntimeError("lost after its rows were written")

        committed.stage(rows.mapInArrow(breaks, rows.schema), "{tmp_path}/sink")
        listed = committed.listing(spark, "{tmp_path}/sink")
        assert listed.count() == 40 and listed.select("path").distinct().count() == 40
        committed.publish(listed).collect()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(script)], check=True, timeout=120, cwd=tmp_path)
    assert (tmp_path / "broken").exists() and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(str(k) for k in range(40))


def test_positions_and_attributes_are_handed_on(spark):
    xattrs = [(PRIVATE_XATTRS[0], b"x"), ("user.note", b"y")]
    rows = [(p, f"/q/{p % 2}.txt", 2, bytearray(b"ab"), xattrs) for p in (3, 1, 2, 0)]
    files = spark.createDataFrame(rows, "pos long, path string, length long, content binary, xattrs array<struct<name: string, value: binary>>")
    assert [(r["pos"], r["place"]) for r in queue.delivered(engine.scan(files)).collect()] == [(k, k + 1) for k in range(4)]
    for remove, kept in ((False, 2), (True, 1)):
        found = engine.clean(files, Options(remove_extended_attributes=remove)).orderBy("pos").collect()
        assert [(r["pos"], len(r["kept_xattrs"]), len(r["removed"])) for r in found] == [(k, kept, int(remove)) for k in range(4)]
