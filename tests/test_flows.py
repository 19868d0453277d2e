import io
import zipfile

import pytest
from pyspark.sql import functions as F

from shardwright.operators import batch, classify, progress, scan
from shardwright.sources import containers, retry


def names_in_order(items):
    """A walk in order: {seq: base}."""
    taken, out = set(), {}
    for seq, folder, stem, name in sorted(items):
        base, n = f"{folder}/{stem}", 1
        while base in taken:
            base = f"{folder}/{name}" + (f"-{n}" if n > 1 else "")
            n += 1
        taken.add(base)
        out[seq] = base
    return out


def test_names_are_those_of_a_walk_in_order(spark):
    items = [(k, "d", "a", "a.pptx") for k in range(0, 60, 2)] + [(k, "d", "a", "a.pptm") for k in range(1, 30, 2)]
    items += [(100, "d", "a.pptx-3", "a.pptx-3.pptx"), (5000, "e", "a", "a.pptx"), (31, "d", "a.pptm", "a.pptm.pptx"), (33, "d", "a.pptx-7", "a.pptx-7.pptm"), (-1, "d", "a.pptx-5", "q"), (-2, "d", "a.pptm-2", "q")]
    got = {r["seq"]: r["base"] for r in batch.settled(spark.createDataFrame(items, "seq long, folder string, stem string, name string")).collect()}
    assert got == names_in_order(items)
    assert batch.settled(spark.createDataFrame([], "seq long, folder string, stem string, name string")).count() == 0


def test_bases_by_roots(spark):
    roots = [("/a/one", 0, False), ("/b/one", 1, False), ("/c/f.pptx", 2, True)]
    files = [("/a/one/x/f.pptx", 0), ("/b/one/f.pptm", 1), ("/b/one/f.pptx", 2), ("/c/f.pptx", 3)]
    frame, schema = spark.createDataFrame(files, "path string, seq long"), "root string, root_no int, is_file boolean"
    got = {r["path"]: r["base"] for r in batch.output_bases(frame, spark.createDataFrame(roots, schema), "out").collect()}
    assert got == {"/a/one/x/f.pptx": "out/one/x/f", "/b/one/f.pptm": "out/one-2/f", "/b/one/f.pptx": "out/one-2/f.pptx", "/c/f.pptx": "out/f"}
    only = batch.output_bases(frame.where("startswith(path, '/a')"), spark.createDataFrame(roots[:1], schema), "out").first()
    assert only["base"] == "out/x/f"


def test_a_second_run_writes_nothing(spark, tmp_path):
    rows = [(f"/r/{r}.pptx", n, bytearray(containers.damaged(r, "text", "seed"))) for n, r in enumerate(containers.RECIPES)] + [("/r/none.pptx", 50, None)]
    files, roots = spark.createDataFrame(rows, "path string, seq long, content binary"), spark.createDataFrame([("/r", 0, False)], "root string, root_no int, is_file boolean")
    folder = str(tmp_path / "store")
    planned = {r["path"]: r for r in batch.run(files, roots, "out", folder, dry_run=True).collect()}
    assert batch.outputs(spark, folder).isEmpty() and not (tmp_path / "store").exists()
    first = {r["path"]: r for r in batch.run(files, roots, "out", folder).collect()}
    repaired = {p for p, r in first.items() if r["action"] == "repaired"}
    assert repaired == {p for p, r in planned.items() if r["action"] == "planned"} and len(repaired) == 8
    assert first["/r/none.pptx"]["action"] == "failed" and first["/r/none.pptx"]["error"] and "/r/normal.pptx" not in first
    assert first["/r/empty_file.pptx"]["action"] == "unrepairable" and first["/r/interior_damage.pptx"]["output"] == "out/interior_damage.repaired.pptx"
    n, runs = batch.outputs(spark, folder).count(), batch.manifest(spark, folder).select("run").distinct().count()
    again = {r["path"]: r["action"] for r in batch.run(files, roots, "out", folder).collect()}
    assert {p for p, a in again.items() if a == "skipped_existing"} == repaired
    assert (batch.outputs(spark, folder).count(), batch.manifest(spark, folder).select("run").distinct().count()) == (n, runs) == (n, 1)
    forced = {r["path"]: r["action"] for r in batch.run(files.where("seq = 8"), roots, "out", folder, force=True).collect()}
    assert set(forced.values()) == {"repaired"} and batch.manifest(spark, folder).select("run").distinct().count() == 2
    deck = batch.outputs(spark, folder).where("output = 'out/interior_damage.repaired.pptx'").first()["payload"]
    with zipfile.ZipFile(io.BytesIO(deck)) as z:
        assert z.testzip() is None
    assert {r["member"].split("/")[0] for r in batch.outputs(spark, folder).where("endswith(output, '.salvaged')").collect()} <= {"parts", "media", "images", "charts"}
    spark.createDataFrame([("gone", "x", "", bytearray(b""))], "run string, output string, member string, payload binary").write.mode("append").parquet(f"{folder}/data")
    assert batch.outputs(spark, folder).where("output = 'x'").isEmpty(), "a run that broke off before its manifest isn't seen"


def test_scan_with_archives_and_progress(spark):
    whole, torn = (containers.damaged(r, "text", "seed") for r in ("normal", "interior_damage"))
    box = containers.stored([("in/a.pptx", whole), ("in/.b.pptx", whole), ("~$c.pptx", torn), ("d.pptx", torn), ("readme.txt", b"x")])
    rows = [("x/a.pptx", "targets", torn, None), ("x/ok.pptx", "targets", whole, None), ("x/no.pptx", "targets", None, "OSError"), ("z/box.zip", "archives", box, None), ("z/bad.zip", "archives", b"junk", None), ("z/no.zip", "archives", None, "OSError")]
    frame = spark.createDataFrame([(p, b, None if c is None else bytearray(c), e) for p, b, c, e in rows], "path string, bucket string, content binary, error string")
    watched = progress.Progress()
    found = scan.scan(frame, progress=watched)
    assert {r["path"]: (r["verdict"], r["read_error"]) for r in found.outcomes.collect()} == {"x/a.pptx": ("interior_damage", None), "x/ok.pptx": ("normal", None), "x/no.pptx": (None, "OSError")}
    assert {(r["label"], r["hidden"]) for r in found.materials.collect()} >= {("z/box.zip::in/a.pptx", False), ("z/box.zip::in/.b.pptx", True), ("z/box.zip::d.pptx", False)}
    assert [r["label"] for r in found.used_materials().orderBy("label").collect()] == ["z/box.zip::d.pptx", "z/box.zip::in/a.pptx"]
    assert {(r["target"], r["donor"], r["confidence"]) for r in found.candidates().collect()} == {("x/a.pptx", "z/box.zip::in/a.pptx", "high"), ("x/a.pptx", "x/ok.pptx", "medium")}
    assert {r["archive"] for r in found.notes.collect()} == {"z/bad.zip", "z/no.zip"}
    counts = watched.counts()
    assert counts["targets"] == {"rows": 3, "damaged": 1, "unread": 1} and counts["material"]["rows"] == found.materials.count() and counts["members"]["rows"] >= 4
    bare = scan.scan(frame, search_archives=False)
    assert bare.materials.isEmpty() and bare.outcomes.count() == 3
    assert scan.scan(frame.where("false")).totals().isEmpty()


def test_fingerprints_count_what_is_beyond(spark):
    rows = [(f"p{k:02}", "targets", bytearray(b"plain text %d" % k), None) for k in range(25)]
    found = scan.scan(spark.createDataFrame(rows, "path string, bucket string, content binary, error string")).fingerprints()
    got = found.collect()
    assert len(got) == 21 and [r["more"] for r in got if r["path"] is None] == [5] and sorted(r["path"] for r in got if r["path"])[-1] == "p19"


def test_passing_errors_are_waited_out():
    tries, slept = [], []

    def late():
        tries.append(1)
        if len(tries) < 3:
            raise OSError(22, "stale")
        return "open"

    assert retry.retrying(late, sleep=slept.append) == ("open", "opened at try 3 after OSError") and slept == list(retry.DELAYS[:2])
    assert retry.retrying(lambda: 1) == (1, None)
    for error in (FileNotFoundError, PermissionError):
        tries.clear()
        with pytest.raises(error):
            retry.retrying(lambda error=error: (tries.append(1), (_ for _ in ()).throw(error()))[1], sleep=slept.append)
        assert len(tries) == 1
    with pytest.raises(OSError):
        retry.retrying(lambda: (_ for _ in ()).throw(OSError()), sleep=slept.append)


def test_stream_progress_adds_up(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join('{"n": %d}' % n for n in range(k + 2)))
    heard = progress.StreamProgress()
    spark.streams.addListener(heard)
    try:
        rows = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).observe("rows", F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") == 0).alias("zeros"))
        q = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert heard.ended.wait(30)
    finally:
        spark.streams.removeListener(heard)
    assert heard.totals["rows"] == {"n": 9, "zeros": 3} and heard.batches >= 3


def test_lost_entries_of_files_without_census(spark):
    rows = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"text")), (3, None)], "file_id long, content binary")
    assert {(r["file_id"], tuple(r["lost_slides"]), r["lost_entries"]) for r in batch.lost(classify.diagnose(rows), "file_id").collect()} == {(1, (), 0), (2, (), 0)}
